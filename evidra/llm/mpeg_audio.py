"""MPEG audio columns: frame resynchronisation, tags, variable-bitrate tables, checksums, durations, seek offsets.

``parse`` reads any MPEG 1/2/2.5 layer I-III stream. ``store`` writes a lossless container in that format: MPEG-2
layer III frames of 576 samples, each carrying 576 payload bytes behind its checksummed side information.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Fixed values of the MPEG audio standard: kbit/s by (version 1?, layer) and index, Hz by version and index.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 576
#: Stored frames: MPEG-2, layer III, protected, 16 kHz, mono; 144 and 160 kbit/s in turn by content.
SYNC, MODE, SIDE = 0xFFF2, 0xC0, 9
SHORT, LONG = 648, 720
HEAD = 4 + 2 + SIDE
SEEK_EVERY = 16


@lru_cache(1 << 14)
def header(word: int) -> tuple[int, int, int, int, int, int, bool] | None:
    """(version, layer, frame bytes, samples, Hz, side bytes, protected) of a 32-bit header; None if invalid or free format."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, hertz = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or word & 3 == 2:
        return None
    kbits, hz, pad = KBITS[version == 3, layer][rate], HERTZ[version][hertz], word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12_000 * kbits // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hz + pad
    mono = word >> 6 & 3 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return version, layer, size, samples, hz, side, not word >> 16 & 1


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC_TABLE = _crc_table()


def crc16(columns: np.ndarray) -> np.ndarray:
    """The format's checksum of each row of bytes."""
    crc = np.full(len(columns), 0xFFFF, np.uint32)
    for column in columns.T:
        crc = (crc << 8 & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ column]
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _tag(n_bytes: int) -> bytes:
    def frame(key: bytes, body: bytes) -> bytes:
        return key + struct.pack(">IH", len(body), 0) + body

    body = frame(b"TIT2", b"\x00text payload") + frame(b"TXXX", b"\x00n_bytes\x00" + str(n_bytes).encode())
    return b"ID3\x03\x00\x00" + _syncsafe(len(body)) + body


def store(data: bytes) -> bytes:
    """The container of data: ID3v2 tag, Xing frame with seek table, payload frames, ID3v1 tag."""
    n = max(1, -(-len(data) // UNIT))
    rows = np.full(n * UNIT, 255, np.uint8)
    rows[: len(data)] = np.frombuffer(data, np.uint8)
    rows = rows.reshape(n, UNIT)
    long = rows[:, 0] & 1 == 1
    out = np.zeros((n, LONG), np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = SYNC >> 8, SYNC & 255, np.where(long, 0xE8, 0xD8), MODE
    out[:, 6 : 6 + SIDE] = rows[:, :SIDE]  # the side information repeats the first bytes, so the checksum guards content
    crc = crc16(np.concatenate([out[:, 2:4], out[:, 6 : 6 + SIDE]], axis=1))
    out[:, 4], out[:, 5] = crc >> 8, crc & 255
    out[:, HEAD : HEAD + UNIT] = rows
    sizes = np.where(long, LONG, SHORT)
    body = out.tobytes() if long.all() else out[np.arange(LONG) < sizes[:, None]].tobytes()
    ends = SHORT + np.concatenate([[0], np.cumsum(sizes)])
    total = int(ends[-1])
    toc = bytes((ends[np.arange(100) * n // 100] * 255 // total).astype(np.uint8))
    first = bytearray(SHORT)
    first[:4] = bytes([SYNC >> 8, SYNC & 255, 0xD8, MODE])
    first[4:6] = int(crc16(np.frombuffer(bytes(first[2:4] + first[6 : 6 + SIDE]), np.uint8)[None])[0]).to_bytes(2, "big")
    first[HEAD : HEAD + 120] = b"Xing" + struct.pack(">III", 15, n, total) + toc + struct.pack(">I", 0)
    end = b"TAG" + b"text payload".ljust(30, b"\x00") + bytes(30 + 30 + 4 + 30) + b"\xff"
    return _tag(len(data)) + bytes(first) + body + end


def _tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """Tags and the bounds of the audio between them."""
    tags: dict[str, str] = {}
    start, end = 0, len(media)
    while media[start : start + 3] == b"ID3" and len(media) >= start + 10:
        major, flags = media[start + 3], media[start + 5]
        size = sum((b & 127) << s for b, s in zip(media[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        at, stop = start + 10, min(start + 10 + size, len(media))
        width = 3 if major == 2 else 4
        while at + (6 if major == 2 else 10) <= stop and media[at] != 0:
            key = media[at : at + width].decode("latin-1")
            if major == 2:
                length, at = int.from_bytes(media[at + 3 : at + 6], "big"), at + 6
            else:
                raw = media[at + 4 : at + 8]
                length = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
                at += 10
            body = media[at : min(at + length, stop)]
            at += length
            if key[:1] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
                if key in ("TXXX", "TXX"):
                    name, _, value = text.partition("\x00")
                    tags[f"{key}:{name}"] = value.rstrip("\x00")
                else:
                    tags[key] = text.rstrip("\x00")
        start = min(start + 10 + size + (10 if flags & 16 else 0), len(media))
    if end - start >= 128 and media[end - 128 : end - 125] == b"TAG":
        tags["TAG:title"] = media[end - 125 : end - 95].split(b"\x00")[0].decode("latin-1")
        end -= 128
    if end - start >= 32 and media[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", media[end - 20 : end - 8])
        tags["APE"] = str(size)
        end = max(start, end - size - (32 if flags & 1 << 31 else 0))
    return tags, start, end


def _table(frame: bytes, side: int, protected: bool) -> dict[str, Any] | None:
    """The variable-bitrate table of a first frame, if it holds one."""
    at = next((x for x in (4 + side, 6 + side) if frame[x : x + 4] in (b"Xing", b"Info")), -1)
    if at >= 0:
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, key, width in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[key] = frame[at : at + 100] if key == "toc" else int.from_bytes(frame[at : at + width], "big")
                at += width
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        return {"kind": "VBRI", "bytes": size, "frames": frames}
    return None


def parse(media: bytes | None, seek_every: int = SEEK_EVERY) -> dict[str, Any]:
    """Frames, tags, tables, checksums and times of an MPEG audio stream.

    A sync word counts only if its frame fits and the next frame (or the end) follows it with the same version,
    layer and sampling rate; other bytes are skipped and counted. Free-format and reserved headers are not frames.
    None or bytes without frames give zero frames. ``duration`` is exact (a Fraction of seconds). Checksums are checked
    in layer III alone, with the first frame's side size; of a VBRI table only bytes and frames are read.
    """
    media = media or b""
    tags, start, end = _tags(media)
    at, skipped, resyncs, lost = start, 0, 0, False
    frames: list[tuple[int, int, int]] = []
    first = None
    word = lambda x: int.from_bytes(media[x : x + 4], "big")
    alike = lambda a, b: b is not None and a[:2] == b[:2] and a[4] == b[4]
    while at + 4 <= end:
        h = header(word(at))
        good = h is not None and at + h[2] <= end and (first is None or alike(first, h))
        if good and (lost or first is None) and at + h[2] + 4 <= end:
            good = alike(h, header(word(at + h[2])))
        if not good:
            following = media.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            skipped, resyncs, lost, at = skipped + following - at, resyncs + (not lost), True, following
            continue
        first, lost = first or h, False
        frames.append((at, h[2], word(at)))
        at += h[2]
    skipped += max(0, end - at)
    vbr = None
    if frames and first:
        vbr = _table(media[frames[0][0] : frames[0][0] + frames[0][1]], first[5], first[6])
    audio = frames[1:] if vbr else frames
    samples, hz = (first[3], first[4]) if first else (0, 1)
    good_crc = bad_crc = 0
    checked = np.array([f[0] for f in frames if first and first[1] == 3 and not f[2] >> 16 & 1], np.int64)
    if len(checked):
        data, side = np.frombuffer(media, np.uint8), first[5]
        offsets = np.concatenate([[2, 3], np.arange(6, 6 + side)])
        stated = data[checked + 4].astype(np.uint32) << 8 | data[checked + 5]
        good_crc = int((crc16(data[checked[:, None] + offsets]) == stated).sum())
        bad_crc = len(checked) - good_crc
    rates = {f[2] >> 12 & 15 for f in audio}
    return {
        "tags": tags, "frames": [(f[0], f[1]) for f in audio], "samples": samples * len(audio), "hertz": hz if first else 0,
        "version": first[0] if first else -1, "layer": first[1] if first else 0, "side": first[5] if first else 0,
        "duration": Fraction(samples * len(audio), hz), "vbr": vbr, "variable": len(rates) > 1, "skipped": skipped,
        "resyncs": resyncs, "crc_good": good_crc, "crc_bad": bad_crc, "seek": [f[0] for f in audio[::seek_every]],
    }


def payload(media: bytes, parsed: dict[str, Any]) -> bytes:
    """The padded payload of a container that :func:`store` wrote."""
    return b"".join([media[at + HEAD : at + HEAD + UNIT] for at, _ in parsed["frames"]])


def feature(parsed: dict[str, Any]) -> str:
    vbr, d = parsed["vbr"] or {}, parsed["duration"]
    agrees = vbr.get("frames") == len(parsed["frames"])
    seek = zlib.crc32(np.array(parsed["seek"], "<u8").tobytes())
    return (
        f"frames={len(parsed['frames'])};samples={parsed['samples']};hz={parsed['hertz']};seconds={d.numerator}/{d.denominator};"
        f"table={vbr.get('kind', '-')};table_ok={int(agrees)};variable={int(parsed['variable'])};crc_ok={parsed['crc_good']};"
        f"crc_bad={parsed['crc_bad']};skipped={parsed['skipped']};seek_points={len(parsed['seek'])};seek_crc32={seek:08x}"
    )


def store_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text in the container; null texts as empty ones, which take one padded frame."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            for at in range(0, len(raw), 128):
                part = raw[at : at + 128]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 128), pa.array([len(x) for x in part], pa.int64()), pa.array([store(x) for x in part], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(id_column, text).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_column)


def read_media(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digests, durations and seek offsets from the stored bytes alone: one row for each row of :func:`store_texts`."""
    kind = media.schema[id_column].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "seek_offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1).to_pylist():
                parsed = parse(m)
                body = payload(m or b"", parsed)
                rows.append((int(parsed["tags"].get("TXXX:n_bytes", 0)), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), feature(parsed), float(parsed["duration"]), parsed["seek"]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek_offsets array<long>"
    return media.select(id_column, "media").mapInArrow(run, schema).withColumnRenamed("id", id_column)


def query(docs: DataFrame) -> DataFrame:
    return read_media(store_texts(docs))
