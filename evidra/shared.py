"""Tables in the folder that the cluster shares: intermediate results that outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="evidra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/evidra/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def named(column: str, of: str | None = None) -> Column:
    """The column of that very name, whatever signs it holds; ``of`` names a struct that it is a field of."""
    quoted = "`" + column.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def free_name(wanted: str, *tables: DataFrame) -> str:
    """The wanted column name, with as many underscores before it as keep it apart from the tables' columns."""
    taken = {c.lower() for df in tables for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
