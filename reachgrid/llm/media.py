"""Texts as lossless WebP in a media column, and features of the pixels that are read back.

A text's UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64, are the
8-bit samples of an image: green values, or four of them an ARGB pixel where that is
smaller. Texts of over a mebibyte go on in further images, one file after the other in the
same column, so that an image's pixels and tables have a bound. ``pixels`` decodes the stored bytes to pixel arrays; checksums and features come
from those arrays alone.

Defined results: a null text is empty (64 bytes 0); equal texts give equal media, of
files of equal size the one with fewer tools; repeated rows are stored each, null keys
too; long texts are stored whole; other columns of any name are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from reachgrid.functions.shared import written
from reachgrid.llm import webp
from reachgrid.llm.common import documents, text_or_empty

BLOCK = 64
#: Samples of an image; back-references reach no further either.
_IMAGE = BLOCK * webp.MAX_SIDE
#: Bytes of texts whose media or pixels are made together; a longer text goes alone.
_BYTES = 1 << 22


def payload(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % BLOCK or (0 if data else BLOCK))


def to_media(data: bytes) -> bytes:
    """Files of ``data``, whose length is a positive multiple of 64."""
    samples = np.frombuffer(data, dtype=np.uint8)
    return b"".join(webp.encode_samples(samples[at : at + _IMAGE], BLOCK) for at in range(0, len(samples), _IMAGE))


def images(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield media[at : at + size]
        at += size


def from_media(media: bytes) -> bytes:
    return b"".join(webp.decode_samples(x).tobytes() for x in images(media))


def _slices(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], list[int]]) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``_BYTES``."""
    for whole in batches:
        run = (np.cumsum(size(whole)) - 1) // _BYTES
        ends = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), whole.num_rows] if whole.num_rows else []
        for a, b in zip(ends, ends[1:]):
            yield whole.slice(a, b - a)


def feature(samples: np.ndarray) -> str:
    """Entropy, mean and number of distinct values of samples, and how often neighbours are equal."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    same = int((samples[1:] == samples[:-1]).sum())
    return f"entropy={entropy:.4f};mean={counts @ np.arange(256) / len(samples):.4f};distinct={len(share)};same={same}"


def stored(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes and media of each document's text."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, lambda b: pa.compute.binary_length(b.column(1)).to_pylist()):
            texts = batch.column(1).to_pylist()
            media = [to_media(payload(t)) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty().alias("text")).mapInArrow(store, f"`{key}` {kind}, n_bytes long, media binary")


PIXELS = "n_bytes long, media_bytes long, media_sha256 string, images array<struct<width: int, height: int, argb: binary>>"


def pixels(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, sizes and checksum of the media, and its images as pixel arrays: 32-bit ARGB, little-endian, row by row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())]))
        for batch in _slices(batches, lambda b: b.column(1).to_pylist()):  # n_bytes
            held = batch.column(2).to_pylist()
            # One image at a time as an array: bytes are all that is kept of it.
            shaped = lambda x: {"width": x.shape[1], "height": x.shape[0], "argb": x.astype("<u4").tobytes()}
            made = [[shaped(webp.decode(x)) for x in images(m)] for m in held]
            columns = [batch.column(0), batch.column(1), pa.array([len(m) for m in held], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in held], pa.string()), pa.array(made, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "media_bytes", "media_sha256", "images"])

    return media.select(key, "n_bytes", "media").mapInArrow(read, f"`{key}` {media.schema[key].dataType.simpleString()}, {PIXELS}")


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of the pixel arrays of ``pixels``: size and checksums of their samples, and the feature."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, lambda b: b.column(1).to_pylist()):  # n_bytes
            rows = []
            for own in batch.column(4).to_pylist():
                data = np.concatenate([webp.samples_of(np.frombuffer(x["argb"], "<u4").reshape(x["height"], x["width"])) for x in own])
                rows.append((len(data), hashlib.sha256(data.tobytes()).hexdigest(), zlib.crc32(data[-BLOCK:].tobytes()), feature(data)))
            size, digest, tail, told = (pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, digest, tail, batch.column(2), batch.column(3), told], names=[key, *names])

    schema = f"`{key}` {decoded.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return decoded.mapInArrow(read, schema)


def write_pixels(decoded: DataFrame, path: str) -> None:
    """The pixel arrays of ``pixels`` as Parquet: a row per document with its images' width, height and ARGB values."""
    decoded.write.mode("overwrite").parquet(path)


def op6_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pixels(written(stored(documents(spark, sf_dir)), "media")))
