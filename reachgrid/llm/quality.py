"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured once and held against five rules. Failures are summed
by host (a sum per task first, so that a hot host is no burden), each host's
failure rate is shrunk towards the mean of all hosts by a beta prior fitted to
the spread between hosts, and hosts whose shrunk rate is above ``host_limit`` are
poor. A document goes if it fails one of the two base rules, or if its host is
poor and it fails any rule; a document that fails none stays wherever it is from.

Defined results: a null text has no words and fails; null hosts are one host;
repeated rows are measured each; a host whose shrunk rate equals the limit is not poor;
long texts are measured whole; other columns of any name are kept by ``kept_documents``;
an empty table gives no rows. Repeated three-word windows are found by hashes whose equal
neighbours are held word against word; a text in which two windows share a hash is sorted
by the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.shared import written
from reachgrid.llm.common import BLANK, WORD, documents, small_or_shuffled, text_or_empty


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    word_chars: tuple[int, int] = (3, 10)
    host_limit: float = 0.5


def measures(docs: DataFrame, *kept: Column, lost_bits: int = 0) -> DataFrame:
    """``kept`` columns, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    ``lost_bits`` shortens the windows' hashes, so that tests can make them equal by chance.
    """
    d = docs.select(*kept, text_or_empty().alias("_text"))
    names = d.columns[:-1]
    d = d.select(
        "*",
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.length("_text") - F.regexp_count("_text", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    d = d.withColumn("_n", F.size("_words")).withColumn("_bits", F.length(F.bin("_n")) + lost_bits)
    # A window's hash with its place in the low bits: sorting brings equal windows together.
    d = d.withColumn("_keys", F.expr("sort_array(transform(slice(_words, 1, greatest(_n - 2, 0)), (w, i) -> shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _bits) | cast(i as long)))"))
    d = d.withColumn("_twice", F.expr("filter(_keys, (x, i) -> shiftright(x, _bits) <=> shiftright(get(_keys, i - 1), _bits) or shiftright(x, _bits) <=> shiftright(get(_keys, i + 1), _bits))"))
    place = lambda x: f"cast({x} & (shiftleft(1L, _bits) - 1) as int)"
    before = "get(_twice, i - 1)"
    word = lambda x, k: f"get(_words, {place(x)} + {k})"
    unlike = " or ".join(f"{word('x', k)} != {word(before, k)}" for k in range(3))
    shared = f"size(filter(_twice, (x, i) -> i > 0 and shiftright(x, _bits) = shiftright({before}, _bits) and ({unlike}))) > 0"
    # Words have no blanks, so three of them with blanks between are told apart as one string.
    windows = "sort_array(transform(slice(_words, 1, greatest(_n - 2, 0)), (w, i) -> struct(concat_ws(' ', w, get(_words, i + 1), get(_words, i + 2)) as w, i as i)))"
    by_words = f"get(transform(array({windows}), s -> transform(filter(s, (x, j) -> x.w <=> get(s, j - 1).w or x.w <=> get(s, j + 1).w), x -> x.i)), 0)"
    places = f"if({shared}, {by_words}, transform(_twice, x -> {place('x')}))"
    covered = f"size(array_distinct(flatten(transform({places}, i -> array(i, i + 1, i + 2)))))"
    # A generator, so that filters on the measures are not pushed into the expressions that make them.
    each = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast({covered} as long)").alias("n_repeat_words"),
    )
    return d.select(*names, F.inline_outer(F.array(each)))


def base_failed(r: Rules) -> Column:
    n = F.col("n_words")
    return (n < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * n)


def any_failed(r: Rules) -> Column:
    n, low, high = F.col("n_words"), *r.word_chars
    return (
        base_failed(r)
        | (100 * F.col("n_symbols") > r.max_symbol_percent * n)
        | (100 * F.col("n_dup_lines") > r.max_dup_line_percent * F.col("n_lines"))
        | (F.col("word_chars") < low * n)
        | (F.col("word_chars") > high * n)
    )


def host_key(host: Column) -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("n"))


def host_rates(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """_host, docs, failed, rate and shrunk rate; ``measured`` needs _host and the measures.

    The prior's mean is that of the hosts' rates and its strength follows from
    their variance (moments), held between 1 and 1,000,000 documents.
    """
    hosts = measured.groupBy("_host").agg(F.count("*").alias("docs"), F.count_if(any_failed(rules)).alias("failed"))
    hosts = written(hosts.withColumn("rate", F.col("failed") / F.col("docs")), "hosts")
    mean, spread = hosts.agg(F.avg("rate"), F.var_pop("rate")).first()
    mean = mean or 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread else 1e6
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    return hosts.withColumn("shrunk", shrunk)


def poor_hosts(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return host_rates(measured, rules).where(F.col("shrunk") > rules.host_limit).select("_host", F.lit(True).alias("_poor"))


def judged(measured: DataFrame, rules: Rules = Rules(), poor: DataFrame | None = None) -> DataFrame:
    """``measured`` with base_failed and kept. Poor hosts are broadcast if few, else joined by shuffle."""
    poor = poor_hosts(measured, rules) if poor is None else poor
    rows = measured.join(small_or_shuffled(poor), "_host", "left")
    rows = rows.withColumn("base_failed", base_failed(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & ~(F.coalesce("_poor", F.lit(False)) & any_failed(rules)))


def kept_documents(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Rows of ``docs`` that the rules keep. Texts are measured once and never shuffled while poor hosts are few."""
    # A struct holds the row, whatever its columns are called; it is written with its measures.
    rows = docs.select(F.struct("*").alias("row"), "text", host_key(F.col(host)).alias("_host"))
    measured = written(measures(rows, F.col("row"), F.col("_host")), "measured")
    return judged(measured, rules).where("kept").select("row.*")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    measured = measures(docs, F.col("doc_id"), host_key(F.col("source")).alias("_host"))
    rows = judged(written(measured, "measures"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM w WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce('h' || source, 'n') AS host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
         OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS failed
  FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS x FROM f GROUP BY host),
p AS (SELECT avg(x / n) AS mean, var_pop(x / n) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1e6) ELSE 1e6 END AS k FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ((x + mean * k) / (n + k) > 0.5 AND failed) AS kept
FROM f JOIN h USING (host), q
"""
