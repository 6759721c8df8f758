"""Delta-maintained token rollups.

Totals by source, language and tokenizer version are never counted anew: each batch
of changes becomes signed sums (an insert adds a document and its tokens, a delete
takes them off, a revised count adds the difference), which are additive. A batch is
written as a delta first and takes effect with its row in the commit log; a batch
that is in the log is skipped when it comes again, and a delta left by a lost attempt
is overwritten. ``compact`` folds committed deltas into one base.

Defined results: null sources and languages are groups of their own; null token
counts are 0; groups whose documents and tokens are both 0 are left out; an empty
batch commits and changes nothing; a null text has no tokens; repeated rows are counted
each; long texts are counted whole; other columns of any name are not read. In
``op4_token_rollup`` copies of a text are those with a doc_id above its least; one with a
null doc_id, or with the least one again, is none; an empty table gives no totals.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.shared import shared_dir, written
from reachgrid.llm.common import WORD, documents, left_join_hot, text_or_empty

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer versions as patterns of a token.
TOKENIZERS = {"blank-1": WORD, "letters-2": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"}


def signed(changes: DataFrame) -> DataFrame:
    """Sums per group of ``changes``: action (insert, delete, revise), keys, tokens, old_tokens."""
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("action") == "insert", 1).when(F.col("action") == "delete", -1).otherwise(0)
    change = F.when(F.col("action") == "insert", tokens).when(F.col("action") == "delete", -tokens).otherwise(tokens - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(change).cast("long").alias("n_tokens"))


class TokenRollup:
    """A rollup in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """batch, number, base: one row per commit; a base stands for all commits before it."""
        schema = "batch string, number long, base boolean"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _commit(self, batch: str, number: int, base: bool, delta: DataFrame) -> None:
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/{number}-{batch}")
        row = self.spark.createDataFrame([(batch, number, base)], "batch string, number long, base boolean")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        log = self.log()
        if log.where(F.col("batch") == batch).limit(1).count():
            return False
        self._commit(batch, log.count(), False, signed(changes))
        return True

    def compact(self) -> None:
        log = self.log()
        self._commit(f"base-{uuid.uuid4().hex}", log.count(), True, self.totals())

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens after all committed batches."""
        log = self.log()
        start = log.where("base").agg(F.max("number")).first()[0] or 0
        # One row per batch since the last base.
        rows = log.where(F.col("number") >= start).orderBy("number").collect()
        paths = [f"{self.path}/deltas/{r['number']}-{r['batch']}" for r in rows]
        deltas = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")


def token_counts(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, text_id, tokenizer, tokens, distinct_tokens.

    ``distinct_tokens`` counts the text without lines that it has before.
    """
    once = F.array_join(F.array_distinct(F.split("_text", "\n")), "\n")
    rows = docs.select("doc_id", "source", "lang", text_or_empty().alias("_text"))
    rows = rows.select("*", F.md5(F.col("_text").cast("binary")).alias("text_id"), once.alias("_once"))

    def of(name: str, pattern: str) -> Column:
        count = lambda c: F.regexp_count(c, F.lit(pattern)).cast("long")
        return F.struct(F.lit(name).alias("tokenizer"), count("_text").alias("tokens"), count("_once").alias("distinct_tokens"))

    counts = F.array(*[of(n, p) for n, p in (tokenizers or TOKENIZERS).items()])
    return rows.select("doc_id", "source", "lang", "text_id", counts.alias("_counts")).select("doc_id", "source", "lang", "text_id", F.inline("_counts"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents in four batches, takes off copies of a text but its first, then counts
    the others anew without repeated lines; a batch that comes twice counts once."""
    counts = written(token_counts(documents(spark, sf_dir)), "token-counts")
    first = written(counts.groupBy("text_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first-of-texts")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    rows = written(left_join_hot(counts, first, "text_id", "n").withColumn("copy", copy), "token-rows")
    none = F.lit(None).cast("long")
    shape = lambda df, action, old=none, new="tokens": df.select(F.lit(action).alias("action"), *KEYS, F.col(new).alias("tokens"), old.alias("old_tokens"))
    loads = {f"load-{k}": shape(rows.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == k), "insert") for k in range(4)}
    batches = [*loads.items(), ("copies", shape(rows.where("copy"), "delete")), ("load-1", loads["load-1"])]
    changed = rows.where("not copy and tokens != distinct_tokens")
    batches.append(("lines", shape(changed, "revise", F.col("tokens"), "distinct_tokens")))
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for i, (batch, changes) in enumerate(batches):
        rollup.apply(batch, changes)
        if i == 3:
            rollup.compact()
    return rollup.totals()


def _counted(name: str, pattern: str) -> str:
    return f"SELECT *, '{name}' AS tokenizer, len(regexp_extract_all(t, '{pattern}')) AS n, len(regexp_extract_all(u, '{pattern}')) AS m FROM d"


ORACLE_SQL = f"""
WITH s AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
d AS (
  SELECT doc_id, source, lang, t, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), chr(10)) AS u,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy
  FROM s),
c AS ({reduce(lambda a, b: a + " UNION ALL " + b, (_counted(n, p) for n, p in TOKENIZERS.items()))})
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(m) AS BIGINT) AS n_tokens
FROM c WHERE NOT copy GROUP BY source, lang, tokenizer
"""
