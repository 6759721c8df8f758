"""Operators against plain code where their plans split hot groups, tables and fields into parts."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachgrid.llm import common, mixing, neardup, pii, ppm, toxicity


def invented(r: random.Random, n: int) -> list[str]:
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def exchanged(r: random.Random, words: list[str], n: int) -> list[str]:
    """``words`` with ``n`` of them exchanged, more than five places apart."""
    words = list(words)
    for slot in r.sample(range(len(words) // 12), n):
        words[slot * 12 + 5] = f"new{r.randrange(10**9)}"
    return words


def jaccard(x: list[str], y: list[str]) -> float:
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y))
    return len(x & y) / len(x | y)


def planted_pairs(r: random.Random, n: int) -> list[tuple[list[str], list[str]]]:
    """Texts of 80 to 300 words, each with a copy of a plain similarity of 0.7 to 0.95."""
    out = []
    for _ in range(n):
        words = invented(r, r.randint(80, 300))
        out.append((words, exchanged(r, words, max(1, round(r.uniform(0.003, 0.035) * len(words))))))
    return out


def recall(spark, n: int, seed: int = 3) -> tuple[int, int, int]:
    """(links planted at 0.81 to 0.95, those found, pairs under 0.78 that share a class)."""
    pairs = planted_pairs(random.Random(seed), n)
    rows = [(2 * i + j, " ".join(t)) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [jaccard(*pair) for pair in pairs]
    same = [got[2 * i] == got[2 * i + 1] for i in range(n)]
    assert all(c // 2 == i // 2 for i, c in got.items())
    return sum(s >= 0.81 for s in near), sum(t for s, t in zip(near, same) if s >= 0.81), sum(t for s, t in zip(near, same) if s < 0.78)


def test_planted_links_are_found(spark):
    planted, found, wrong = recall(spark, 1_500)
    assert planted > 600 and found >= 0.98 * planted and wrong == 0


def test_large_group_is_dealt_into_parts_and_blocks(spark, monkeypatch):
    """A group of 500 copies near and not so near each other, with parts, hubs and blocks of few texts."""
    monkeypatch.setattr(neardup, "SPREAD", 16)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    blocks = []
    plain = neardup._block_links
    monkeypatch.setattr(neardup, "_block_links", lambda rows, *rest: blocks.append(rows.agg(F.max("n")).first()[0]) or plain(rows, *rest))
    r = random.Random(11)
    base = invented(r, 150)
    texts = [" ".join(exchanged(r, base, r.choice([0, 1, 1, 2, 3, 5, 7]))) for _ in range(500)] + [" ".join(invented(r, 60)) for _ in range(50)]
    texts = list(dict.fromkeys(texts))
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    grams = [sorted({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in map(str.split, texts)]
    column = {g: i for i, g in enumerate(sorted({g for own in grams for g in own}))}
    has = np.zeros((len(texts), len(column)))
    for i, own in enumerate(grams):
        has[i, [column[g] for g in own]] = 1
    group = np.array([int(neardup.shingles([" ".join(g)])[1][0]) >> 64 - neardup.CLASS_BITS for g in column])
    n = np.zeros(1 << neardup.CLASS_BITS)
    for own in has:
        n[np.unique(group[own > 0])] += 1
    idf = 1 + np.log((len(texts) + 1) / (n[group] + 1)) / np.log(1 << neardup.CLASS_BITS)
    both = (has * idf) @ has.T
    size = np.diag(both)
    near = both / (size[:, None] + size[None, :] - both) >= 0.8
    want = np.arange(len(texts))
    while True:
        low = np.where(near, want[None, :], len(texts)).min(axis=1)
        if (low == want).all():
            break
        want = low
    assert blocks and max(blocks) > 2 * neardup.BLOCK
    assert all(want[c] == want[i] for i, c in got.items())
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got)


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    r = random.Random(2)
    links = [("hub", f"n{i:03}") for i in range(60)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(70)] + [(f"r{r.randrange(80):02}", f"r{r.randrange(80):02}") for _ in range(70)]
    links = [(a, b) for a, b in links if a != b]
    least = {x: x for pair in links for x in pair}
    for _ in range(len(least)):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {x["node"]: x["root"] for x in neardup.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == least


def test_rows_of_one_id_are_mixed_over_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source")).unionByName(
        spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("d e").alias("text"), F.lit(None).cast("string").alias("source"))
    )
    sizes = mixing._numbered(rows, F.col("doc_id"), F.col("source"), mixing.size_of().alias("size"))
    served = mixing.schedule(sizes)[0]
    per = served.where("doc_id is null").select("served").collect()
    assert sorted(r[0] for r in per) == [3 * i for i in range(1, 20_001)]
    # Rows that only their number tells apart lie in several sorted parts.
    assert mixing.swept(sizes, [F.col("doc_id"), F.col("row")], ["size"]).where("doc_id is null").select("before_size").distinct().count() == 20_000
    out = mixing.mixed_words(rows).groupBy("source_size").agg(F.sum("taken").alias("n")).collect()
    assert {r["source_size"]: r["n"] for r in out} == {60_000: 64_000 - 12_000, 4_000: 12_000}


def test_sources_beyond_a_broadcast_give_the_same_mix(spark, monkeypatch):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', int(id % 7))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 40))").alias("source"))
    want = sorted(map(tuple, mixing.mixed_words(rows).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    assert sorted(map(tuple, mixing.mixed_words(rows).collect())) == want


def exact(unary: np.ndarray, links: list, step: np.ndarray) -> np.ndarray:
    """Marginals by all labellings of tokens and group nodes."""
    n = len(unary)
    whole = max((x[1] + 1 for x in links), default=n)
    out = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=whole):
        score = sum(unary[i, labels[i]] for i in range(n)) + sum(step[labels[i], labels[i + 1]] for i in range(n - 1))
        score += sum(s for a, b, s in links if labels[a] == labels[b])
        for i in range(n):
            out[i, labels[i]] += math.exp(score)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize(("tokens", "linked", "most"), [(1, (), 1e-9), (2, (), 1e-6), (5, (), 1e-6), (4, (0, 3), 0.02), (5, (0, 2, 4), 0.12)])
def test_beliefs_by_all_labellings(tokens, linked, most):
    """Exact on chains, a single token among them; near on fields with a loop."""
    rng = np.random.default_rng(tokens)
    for _ in range(3):
        unary, step = rng.normal(size=(tokens, 5)), rng.normal(scale=0.5, size=(5, 5))
        links = [(i, tokens, 1.0) for i in linked]
        got = pii.beliefs(unary, links, step)
        assert got.shape == (tokens, 5) and np.abs(got - exact(unary, links, step)).max() <= most


def test_ftrl_by_a_plain_loop(spark):
    """Weights of the operator are those of a loop over dictionaries, repeated rows and labels among the examples."""
    r = random.Random(4)
    bad, good = invented(r, 4), invented(r, 60)
    texts = [" ".join(r.choice(good) for _ in range(20)) for _ in range(120)]
    labels = [i % 3 == 0 for i in range(120)]
    texts = [t + f" {r.choice(bad)} {r.choice(bad)}" if toxic else t for t, toxic in zip(texts, labels)]
    rows = [(t, int(toxic), f"{i:04}") for i, (t, toxic) in enumerate(zip(texts, labels))]
    rows += [(texts[0], 1, "0200"), (texts[0], 0, "0201"), ("", 0, "0202")]
    p = toxicity.Ftrl(l1=0.5, epochs=2)
    got = toxicity.learn(spark.createDataFrame(rows, "text string, label int, order string"), p)
    z, n = Counter(), Counter()

    def weight(f):
        return 0.0 if abs(z[f]) <= p.l1 else (math.copysign(p.l1, z[f]) - z[f]) / ((p.beta + math.sqrt(n[f])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for text, label, _ in rows:
            found = {int(f) for f in toxicity.features([text], p.bits)[1]} - {1 << p.bits}
            held = {f: weight(f) for f in [*found, "bias"]}
            g = 1 / (1 + math.exp(-sum(held.values()))) - label
            for f, w in held.items():
                rate = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / p.alpha
                z[f] += g - rate * w
                n[f] += g * g
    want = np.zeros((1 << p.bits) + 1)
    for f in z:
        want[-1 if f == "bias" else f] = weight(f)
    assert np.count_nonzero(want) > 5 and np.allclose(got, want, atol=1e-5)


def test_ppm_parts_of_few_entries(spark, monkeypatch):
    """Symbols outside the head are scored alike by one part of the trie and by hundreds."""
    r = random.Random(9)
    texts = ["".join(r.choice("abcde \n") for _ in range(r.randint(0, 90))) for _ in range(40)] + [None, "", "é€𝄞 a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x["doc_id"]: x["score"] for x in ppm.scores(docs).collect()}
    monkeypatch.setattr(ppm, "_PART", 50)
    got = {x["doc_id"]: x["score"] for x in ppm.scores(docs, ppm.Limits(max_entries=0)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
