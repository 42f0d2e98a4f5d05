"""The versioned table: killed, repeated and racing writers leave what one clean run leaves."""

from __future__ import annotations

import pytest

from evidra.sources.versions import VersionedTable


class Killed(Exception):
    pass


def shards(spark):
    make = lambda k: lambda: spark.createDataFrame([(f"c{i}", k, f"co{i % 3}") for i in range(k * 5, k * 5 + 8)] + [(f"c{k * 5}", k, f"co{k * 5 % 3}")], "chunk_id string, v int, corp string")
    return {f"shard-{k}": make(k) for k in range(3)}


def rows(df):
    return sorted(tuple(r) for r in df.select("chunk_id", "v", "corp").collect())


@pytest.mark.parametrize("step", ["_write", "measure", "_publish", "after"])
def test_a_killed_build_goes_on(spark, tmp_path, monkeypatch, step):
    clean = rows(VersionedTable(spark, str(tmp_path / "clean"), partition="corp").rebuild(shards(spark), 18))
    assert clean == [(f"c{i}", min(i // 5, 2), f"co{i % 3}") for i in range(18)] or len(clean) == 18
    table, calls = VersionedTable(spark, str(tmp_path / "killed"), partition="corp"), []
    name = "_publish" if step == "after" else step
    real = getattr(VersionedTable, name)

    def dies(self, *args):
        calls.append(1)
        if step == "after":
            real(self, *args)
        if len(calls) == 2:
            raise Killed
        return True if step == "after" else real(self, *args)

    monkeypatch.setattr(VersionedTable, name, dies)
    with pytest.raises(Killed):
        table.rebuild(shards(spark), 18)
    monkeypatch.undo()
    assert rows(table.rebuild(shards(spark), 18)) == clean and table.verify() == []
    assert rows(table.rebuild(shards(spark), 18)) == clean and len(table.batches()) == 3
    table.compact()
    assert rows(table.rebuild(shards(spark), 18)) == clean and len(table.batches()) == 1 and table.verify() == []
    assert table.sweep() and rows(table.read()) == clean


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    first = spark.createDataFrame([("x", 1), ("y", 1)], "chunk_id string, v int")
    second = spark.createDataFrame([("y", 2), ("z", 2)], "chunk_id string, v int")
    real, raced = VersionedTable._publish, []

    def late(self, batches, version):
        if not raced:  # the other writer publishes between reading and publishing
            raced.append(1)
            b.commit(second, "second")
        return real(self, batches, version)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    a.commit(first, "first")
    monkeypatch.undo()
    assert [x.names for x in a.batches()] == [("second",), ("first",)] and a.versions() == [1, 2]
    assert sorted(map(tuple, a.read().collect())) == [("x", 1), ("y", 1), ("z", 2)] and a.read(1).count() == 2
    a.commit(second, "second")
    assert a.versions() == [1, 2]
    with pytest.raises(ValueError):
        a.commit(first, "third", expected=3)
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "none")).read()
    with pytest.raises(Exception, match="no key"):
        a.commit(spark.createDataFrame([(None, 1)], "chunk_id string, v int"), "fourth")
