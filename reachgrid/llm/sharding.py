"""Reproducible shuffles into shards by a Feistel permutation with cycle walking.

Rows are numbered once, in the order of doc_id, checksum and size; the permutation sends
row number ``i`` of ``n`` to a place ``p`` under ``n``, and ``p`` gives both the shard (``p``
modulo the shards) and the slot in it (``p`` divided by them). Sizes of shards differ
by one at most. The permutation is computed from the seed and ``n`` alone and has an
inverse, so that the row number at any shard and slot is known without a search (`row_at`).

A number is two digits, of bases ``a`` and ``b`` with ``a b`` just not under ``n``. Rounds add
to each digit in turn a keyed function of the other; a result that is not under ``n`` is sent
through again until it is, which about one in a root of ``n`` needs.

Defined results: a null text has 16 bytes and the checksum of nothing; rows without a
doc_id come first; repeated rows are separate, and which of equal rows has which place
is the same for the same files; long texts count whole; other columns of any name are kept
by ``sharded_documents`` and not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.numbering import dense_index
from reachgrid.functions.shared import written
from reachgrid.llm.common import documents, text_or_empty

SHARDS, SEED, ROUNDS = 40, "shard-1", 8
#: Bytes that a document takes besides its text.
OVERHEAD = 16
_PRIME = 2**31 - 1


class Permutation:
    """Of the numbers under ``n``, for arrays; ``n`` up to 2^61."""

    def __init__(self, n: int, seed: str = SEED, rounds: int = ROUNDS):
        self.n = n
        self.a = math.isqrt(max(0, n - 1)) + 1
        self.b = -(-n // self.a) or 1
        key = lambda r, use: 1 + int.from_bytes(hashlib.sha256(f"{seed}:{r}:{use}".encode()).digest()[:4], "big") % (_PRIME - 1)
        self.keys = [(key(r, "times"), key(r, "plus"), key(r, "again")) for r in range(rounds)]

    def _drawn(self, turn: int, x: np.ndarray) -> np.ndarray:
        times, plus, again = self.keys[turn]
        t = (x * times + plus) % _PRIME
        t = (t ^ t >> 16) * again % _PRIME
        return t ^ t >> 15

    def _walked(self, x: np.ndarray, once) -> np.ndarray:  # noqa: ANN001
        out = once(np.asarray(x, dtype=np.int64))
        while len(over := np.flatnonzero(out >= self.n)):
            out[over] = once(out[over])
        return out

    def place(self, number: np.ndarray) -> np.ndarray:
        def once(x: np.ndarray) -> np.ndarray:
            left, right = np.divmod(x, self.b)
            for turn in range(len(self.keys)):
                if turn % 2 == 0:
                    left = (left + self._drawn(turn, right)) % self.a
                else:
                    right = (right + self._drawn(turn, left)) % self.b
            return left * self.b + right

        return self._walked(number, once)

    def number(self, place: np.ndarray) -> np.ndarray:
        """The inverse of ``place``."""

        def once(x: np.ndarray) -> np.ndarray:
            left, right = np.divmod(x, self.b)
            for turn in reversed(range(len(self.keys))):
                if turn % 2 == 0:
                    left = (left - self._drawn(turn, right)) % self.a
                else:
                    right = (right - self._drawn(turn, left)) % self.b
            return left * self.b + right

        return self._walked(place, once)


def shard_sizes(n: int, shards: int = SHARDS) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: str = SEED) -> int:
    """Number of the row that stands at ``slot`` of ``shard``."""
    if not (0 <= shard < shards and 0 <= slot < shard_sizes(n, shards)[shard]):
        raise ValueError(f"no slot {slot} in shard {shard} of {n} rows")
    return int(Permutation(n, seed).number(np.array([slot * shards + shard]))[0])


def placed(rows: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``rows`` (stored; doc_id, text_crc32, size, row) with number, shard and slot."""
    n = rows.count()
    numbered = dense_index(rows, [F.col(c) for c in ("doc_id", "text_crc32", "size", "row")], "number")
    at = Permutation(n, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, shard = np.divmod(at.place(batch.column("number").to_numpy()), shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(slot)], names=[*batch.schema.names, "shard", "slot"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInArrow(deal, f"{kinds}, shard int, slot long")


def _measured(*columns: Column) -> list[Column]:
    octets = F.encode(text_or_empty(), "UTF-8")
    return [F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text_or_empty()) + OVERHEAD).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"), *columns]


def shard_places(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, number, shard and slot of each row."""
    rows = written(docs.select(*_measured()), "sizes")
    return placed(rows, shards, seed).select("doc_id", "size", "text_crc32", "number", "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, dealt by shard and sorted by slot: ready to be written by shard."""
    if clash := {"shard", "slot"} & set(docs.columns):
        raise ValueError(f"documents have columns {sorted(clash)} already")
    held = written(docs.select(*_measured(F.struct("*").alias("held"))), "held")
    at = placed(held.drop("held"), shards, seed).select("row", "shard", "slot")
    rows = held.select("row", "held").join(at, "row")
    # A shard of any size is dealt over ranges of its slots.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    return rows.select("held.*", "shard", "slot")


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_places(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
