"""Media columns: byte payloads as lossless WebP images, and images as pixel arrays with features.

A payload is padded with bytes 255 to a positive multiple of 576 and laid out as RGBA pixels, 144 to a row.
Payloads of more than MAX_ROWS rows become several images, one file after the other. Reading decodes the
stored files - prefix codes, back-references, colour cache, and the inverse of all four transforms - into
pixel arrays. Writing uses prefix codes for every image, references, cache or palette where its pixels repeat, and a
predictor, cross-colour or subtract-green transform where that saves bits. Both directions are Arrow-batched per-row work inside one stage; nothing is shuffled.

Defined cases: null payloads count as empty and become one row of bytes 255; equal payloads give equal files
and features; repeated rows and null ids are carried along; empty tables give empty results.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp

BLOCK = 576
ROW_PIXELS = BLOCK // 4
MAX_ROWS = webp.MAX_SIDE
#: Bytes of files that are read at once.
PORTION = 4 << 20


def store_bytes(payload: bytes) -> bytes:
    """The padded payload as one or more lossless WebP files."""
    payload += b"\xff" * ((-len(payload) % BLOCK) or (0 if payload else BLOCK))
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 4)
    red, green, blue, alpha = (pixels[:, i].astype(np.uint32) for i in range(4))
    argb = alpha << 24 | red << 16 | green << 8 | blue
    step = ROW_PIXELS * MAX_ROWS
    files = []
    for a in range(0, len(argb), step):
        part = argb[a : a + step]
        rows = len(part) // ROW_PIXELS
        files.append(webp.encode(part, ROW_PIXELS, rows, **webp.best_form(part, ROW_PIXELS, rows)))
    return b"".join(files)


def read_many(media: list[bytes]) -> list[tuple[int, int, bytes]]:
    """width, height and RGBA samples of each entry: one file, or several of one width, stacked."""
    files, owner = [], []
    for k, entry in enumerate(media):
        at = 0
        while at < len(entry):
            size = 8 + struct.unpack("<I", entry[at + 4 : at + 8])[0]
            files.append(entry[at : at + size])
            owner.append(k)
            at += size
    out = [(0, 0, b"")] * len(media)
    for k, (width, height, argb) in zip(owner, webp.decode_many(files), strict=True):
        # From blue, green, red, alpha.
        samples = np.ascontiguousarray(np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]).tobytes()
        out[k] = (width, out[k][1] + height, out[k][2] + samples)
    return out


def read_pixels(media: bytes) -> tuple[int, int, bytes]:
    return read_many([media])[0]


def portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of entries of at most PORTION bytes together, one entry at least."""
    begin = held = 0
    for k, n in enumerate(sizes):
        if k > begin and held + n > PORTION:
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def describe(width: int, height: int, samples: bytes) -> str:
    """Size, mean, deviation and entropy of the samples, and a hash of which of 64 areas are brighter than the mean."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    mean = float(counts @ np.arange(256)) / len(x)
    spread = float(counts @ (np.arange(256) - mean) ** 2 / len(x)) ** 0.5
    cuts = np.arange(64) * len(x) // 64
    areas = np.add.reduceat(x, cuts, dtype=np.int64) / np.maximum(np.diff(np.append(cuts, len(x))), 1)
    bits = int("".join("1" if a > mean else "0" for a in areas), 2)
    return f"{width}x{height};mean={mean:.3f};sd={spread:.3f};entropy={float(-(share * np.log2(share)).sum()):.4f};ahash={bits:016x}"


def encode_media(rows: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """id, n_bytes and media for every row; payload_col holds binary."""
    kind = rows.select(F.col(id_col)).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [store_bytes(x.as_py() or b"") for x in b.column(1)]
            sizes = [len(x.as_py() or b"") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return rows.select(F.col(id_col), F.col(payload_col)).mapInArrow(encode, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def decode_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds width, height, pixels (RGBA samples, row by row) and feature to a table with a column of WebP files."""
    others = [f for f in media.schema if f.name not in ("width", "height", "pixels", "feature")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "width int, height int, pixels binary, feature string"])
    place = [f.name for f in others].index(media_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # In portions: pixels take more room than their files.
            for begin, end in portions([len(x.as_py() or b"") for x in whole.column(place)]):
                b = whole.slice(begin, end - begin)
                found = [x if x[2] else (0, 0, None) for x in read_many([x.as_py() or b"" for x in b.column(place)])]
                told = [describe(*x) if x[2] else None for x in found]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))), pa.array(told, pa.string())],
                    names=[*b.schema.names, "width", "height", "pixels", "feature"],
                )

    return media.select(*[media[f.name] for f in others]).mapInArrow(decode, schema)
