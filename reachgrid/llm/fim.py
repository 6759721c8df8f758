"""Fill-in-middle cuts from an index of distinct texts.

Documents with one text are grouped, and Spark's grouping compares whole texts, so a
group is verified content whatever its hash. The ends of a text's tokens are found
once for its group and kept as an Elias-Fano list (`EliasFano`), some two to four bits
a token. Each document of the group then draws its own cut from its id and selects the
two ends of its middle from that list.

Groups of many copies are dealt into parts of about `PART` documents, so that neither
the ids of a group nor the outputs made of it meet in one task; each part finds the
ends once. Texts are moved once, and copies that one task holds are moved as one.

Defined results: a null text is an empty one, which stays plain; a null doc_id draws
from an empty number; repeated rows are separate documents with equal cuts; long texts
are cut whole; tokens are runs of A-Z and a-z or single other code points; other columns
of any name are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.shared import written
from reachgrid.llm.common import HOT_SHARE, documents, text_or_empty
from reachgrid.llm.words import slices

#: Fixed marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of 100 documents so many are cut at all, and so many of those put the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20
#: Documents of one text that meet in a task, about.
PART = 4096
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class EliasFano:
    """A list of rising whole numbers: low bits side by side, high bits in unary, and counts of ones to select by."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        high = (values >> self.low_bits) + np.arange(self.n)
        ones = np.zeros((int(high[-1]) if self.n else 0) + 1, dtype=np.uint8)
        ones[high] = self.n > 0
        self.high = np.packbits(ones, bitorder="little")
        shifts = np.arange(self.low_bits, dtype=np.int64)
        self.low = np.packbits((values[:, None] >> shifts & 1).astype(np.uint8).ravel(), bitorder="little")
        # Ones up to and with each byte.
        self.upto = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Values at the places ``k``, from 0."""
        byte = np.searchsorted(self.upto, k, side="right")
        rank = k - np.where(byte > 0, self.upto[byte - 1], 0)
        bits = np.unpackbits(self.high[byte][:, None], axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, axis=1) > rank[:, None], axis=1)
        high = byte * 8 + inside - k
        if not self.low_bits:
            return high
        at = k[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (self.low[at >> 3] >> (at & 7) & 1).astype(np.int64) << np.arange(self.low_bits)
        return high << self.low_bits | low.sum(axis=1)

    @property
    def n_bytes(self) -> int:
        return len(self.high) + len(self.low)


def token_ends(texts: list[str]) -> list[EliasFano]:
    """Where the tokens of each text end, counted in code points."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # a code point each
    letter = _LETTER[data[starts]]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    last = np.cumsum(sizes)
    # A token goes on if this code point and the next of the same text are letters.
    end = np.ones(len(starts), dtype=bool)
    end[:-1] = ~(letter[:-1] & letter[1:])
    end[last[sizes > 0] - 1] = True
    places = np.flatnonzero(end) + 1
    bounds = np.searchsorted(places, last, side="right")
    return [EliasFano(places[a:b] - start) for a, b, start in zip([0, *bounds], bounds, last - sizes)]


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, b = output.index(second), output.index(MIDDLE)
    one, two, middle = output[len(first) : a], output[a + len(second) : b], output[b + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def groups(docs: DataFrame, part: int = PART) -> DataFrame:
    """text and ``docs``, the doc_ids that have it; a text of many documents has several rows of about ``part`` each."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_key", F.xxhash64("text"))
    counts = written(rows.groupBy("_key").agg(F.count("*").alias("_n")), "text-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # Fewer than HOT_SHARE keys by construction.
    hot = counts.where(F.col("_n") > max(part, total // HOT_SHARE)).select("_key", F.ceil(F.col("_n") / part).alias("_parts"))
    rows = rows.join(F.broadcast(hot), "_key", "left")
    # Documents without an id are dealt by their place too.
    dealt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1)))
    rows = rows.select("_key", dealt.alias("_part"), "text", F.struct("doc_id").alias("doc"))
    return rows.groupBy("_key", "_part", "text").agg(F.collect_list("doc").alias("docs")).select("text", F.col("docs.doc_id").alias("docs"))


CUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def cut_documents(docs: DataFrame, seed: str = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output of each document."""

    def rows(texts: list[str], ids: list[list[int | None]]) -> Iterator[tuple]:
        for text, ends, own in zip(texts, token_ends(texts), ids):
            marked = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
            h = np.array([draws(i, seed) for i in own], dtype=np.int64).reshape(-1, 4)
            plain = np.full(len(own), marked) | (h[:, 2] % 100 >= cut_percent)
            units = np.sort(h[:, :2] % (ends.n + 1), axis=1).ravel()
            chars = np.zeros(len(units), dtype=np.int64)
            chars[units > 0] = ends.select(units[units > 0] - 1)
            for i, (a, b), as_is, first in zip(own, chars.reshape(-1, 2).tolist(), plain.tolist(), (h[:, 3] % 100 < spm_percent).tolist()):
                if as_is:
                    yield i, ends.n, "plain", None, None, text
                elif first:
                    yield i, ends.n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
                else:
                    yield i, ends.n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))

    return _made(docs, rows, CUTS)


DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _made(docs: DataFrame, rows, schema: str) -> DataFrame:  # noqa: ANN001
    """``rows`` of the texts and doc_ids of ``groups(docs)``, some megabytes of output to a batch."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(every):
                held, size = [], 0
                for row in rows(every[a:b], ids[a:b]):
                    held.append(row)
                    size += len(row[5])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return groups(docs).mapInArrow(make, schema)


def digests(cuts: DataFrame) -> DataFrame:
    """Checksums of the outputs of ``cut_documents`` and of the texts rebuilt from them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out, form = batch.column(5).to_pylist(), batch.column(2).to_pylist()
            made = [pa.array(map(sha, out), pa.string()), pa.array((sha(restored(o, f)) for o, f in zip(out, form)), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return cuts.mapInArrow(read, DIGESTS)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(cut_documents(documents(spark, sf_dir)))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form != 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form != 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
