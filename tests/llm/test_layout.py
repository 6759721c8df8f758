"""Fill-in-middle cuts, shards and ranked search against plain code."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reachgrid.llm import fim, lexical, sharding

SCHEMA = "doc_id long, text string, shard_ string, number int, size string"


def texts() -> list[str | None]:
    r = random.Random(5)
    some = [" ".join(r.choice(["alpha", "Beta", "gamma2", "öl", "x_y", "of", "the"]) for _ in range(r.randint(1, 90))) for _ in range(60)]
    return [*some, *some[:9], "", None, "a", "\n", "<P> marked <S>", "a<", "<M", "é😀ß" * 40, "word " * 4000, "x" * 9000, "1,2;3", *["same text of many"] * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, "s") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None), (-7, "Beta the", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_elias_fano_gives_back_every_value():
    r = np.random.default_rng(3)
    for values in ([1], [5], [1, 2, 3], [1000000], list(range(1, 300)), [7, 7000, 7001, 90000], np.cumsum(r.integers(1, 50, 5000)).tolist()):
        array = np.array(values, dtype=np.int64)
        held = fim.EliasFano(array)
        assert held.select(np.arange(len(values))).tolist() == values
        assert held.n_bytes <= 2 + len(values) * (2 + math.log2(max(2, 2 * values[-1] / len(values)))) / 8 + 8


def test_token_ends_by_brute_force():
    some = [t for t in texts() if t is not None]
    for text, ends in zip(some, fim.token_ends(some)):
        want = [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text, re.S)]
        assert ends.n == len(want) and ends.select(np.arange(ends.n)).tolist() == want


def plain_cut(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n, a, b = len(units), *sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, n, form, None if form == "plain" else len(pre), None if form == "plain" else len(mid), sha(out), sha(text)


@pytest.mark.parametrize("part", [fim.PART, 8])
def test_cuts_by_brute_force(docs, empty, monkeypatch, part):
    """Also with groups dealt into parts."""
    monkeypatch.setattr(fim.groups, "__defaults__", (part,))
    rows = Counter(tuple(r) for r in fim.digests(fim.cut_documents(docs)).collect())
    want = Counter(plain_cut(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert rows == want and {r[2] for r in rows} == {"plain", "psm", "spm"}
    assert fim.cut_documents(empty).collect() == []
    most = max(len(r["docs"]) for r in fim.groups(docs).where("text = 'same text of many'").collect())
    assert most == 40 if part > 40 else most < 30


def test_outputs_give_back_texts(docs):
    cut = {r["doc_id"]: r for r in fim.cut_documents(docs).collect() if r["doc_id"] is not None}
    for r in docs.where("doc_id is not null").select("doc_id", "text").collect():
        assert fim.restored(cut[r["doc_id"]]["output"], cut[r["doc_id"]]["form"]) == (r["text"] or "")


def test_permutation_is_one_to_one_and_has_its_inverse():
    for n in [*range(1, 60), 97, 1000, 4097, 100_000]:
        at = sharding.Permutation(n)
        places = at.place(np.arange(n))
        assert np.array_equal(np.sort(places), np.arange(n))
        assert np.array_equal(at.number(places), np.arange(n))
    # Numbers far over those of one machine's rows stay in range and come back.
    big = 10**15 + 7
    some = np.random.default_rng(1).integers(0, big, 5000)
    assert np.array_equal(sharding.Permutation(big).number(sharding.Permutation(big).place(some)), some)


def test_permutation_mixes():
    n = 40_000
    places = sharding.Permutation(n).place(np.arange(n))
    assert abs(np.corrcoef(places, np.arange(n))[0, 1]) < 0.02
    # Neighbours part: 40 shards take about a fortieth of the pairs each.
    assert abs(np.mean(places[1:] % 40 == places[:-1] % 40) - 1 / 40) < 0.005
    assert not np.array_equal(places, sharding.Permutation(n, "other").place(np.arange(n)))


def test_shards_by_brute_force(docs, empty):
    rows = sharding.shard_places(docs, 7).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    bytes_of = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len(bytes_of(r["text"])) + 16, zlib.crc32(bytes_of(r["text"]))) for r in docs.collect())
    assert [key(r) for r in sorted(rows, key=lambda r: r["number"])] == sorted(map(key, rows))
    n = len(rows)
    for s, many in enumerate(sharding.shard_sizes(n, 7)):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(many))
        assert [r["number"] for r in own] == [sharding.row_at(s, r["slot"], n, 7) for r in own]
    again = sharding.shard_places(docs.repartition(2), 7)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in again.collect()) == Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert sharding.shard_places(empty).collect() == []
    with pytest.raises(ValueError, match="no slot"):
        sharding.row_at(0, n, n, 7)


def test_sharded_documents_keep_columns(docs, empty):
    rows = sharding.sharded_documents(docs, 7)
    assert rows.columns == [*docs.columns, "shard", "slot"]
    assert Counter(tuple(r)[:5] for r in rows.collect()) == Counter(map(tuple, docs.collect()))
    assert sharding.sharded_documents(empty).collect() == []
    with pytest.raises(ValueError, match="already"):
        sharding.sharded_documents(docs.withColumnRenamed("shard_", "shard"))


def words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(rows: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(i, Counter(words(t)), len(words(t))) for i, t in rows]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(s for s in scores if s[0])[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "Beta of the gamma2 beta"), (2, "öl"), (3, "nowhere to be found"), (4, None), (5, "WORD word é😀ß same text"), (6, "x y"), (6, "alpha"), (7, "the " * 50)]


@pytest.mark.parametrize("per_shard", [20_000, 7])
def test_search_by_brute_force(spark, docs, empty, monkeypatch, per_shard):
    """Also with shards of seven documents, and with three items to a pass."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", per_shard)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    shards = lexical.index(docs).cache()
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, 10)
    for block in (lexical.QUERY_BLOCK, 3):
        assert sorted(map(tuple, lexical.search(shards, items, 10, block).collect()), key=str) == want
    assert lexical.search(lexical.index(empty), items).collect() == []
    assert lexical.search(shards, items.where("item_id > 99")).collect() == []


def test_search_over_many_documents(spark):
    """Skewed terms and many ties, several shards to a task."""
    r = random.Random(8)
    rows = [(i, " ".join(f"w{min(int(r.paretovariate(0.7)), 400)}" for _ in range(r.randint(1, 60)))) for i in range(3000)]
    rows += [(5000 + i, rows[17][1]) for i in range(30)]
    items = [(i, rows[i * 7][1]) for i in range(40)] + [(99, rows[17][1])]
    shards = lexical.index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = lexical.search(shards, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, items, 10)


def test_blocks_skip_postings_of_frequent_terms():
    r = random.Random(2)
    shard = lexical._shard(list(range(5000)), [" ".join(f"w{min(int(r.paretovariate(0.8)), 900)}" for _ in range(40)) for _ in range(5000)])
    queries = lexical.Queries([(0, "w1 w60 w70"), (1, "w2 w50 w80")])
    own = shard[2].view(np.uint64)
    df = np.array([shard[3][np.searchsorted(own, t)] for t in queries.terms])
    weights = np.floor(1000 * np.log(10_002 / (2 * df + 1))).astype(np.int64)
    damping = 25 + 75 * shard[1].astype(np.int64) * 5000 // int(shard[1].sum())
    ids = np.stack([np.zeros(5000, np.int64), np.arange(5000)], axis=1)
    asked, read = lexical.search_shard((own, *shard[3:6]), ids, queries, weights, damping, lexical.Best(2, 10))
    assert 0 < read < asked / 4


def test_block_boundaries_are_best_of_all():
    """Dynamic programming against all cuts of short lists."""
    r = np.random.default_rng(4)
    lists = [r.integers(1, 1000, int(n)) for n in r.integers(1, 10, 60)]
    starts = lexical.block_starts(np.concatenate(lists), np.array([len(x) for x in lists]), most=4, price=1.5)
    begin = 0
    for own in lists:
        price = 1.5 * (own.max() - own.mean()) + 1e-9
        cost = lambda cuts: sum(own[a:b].max() * (b - a) + price for a, b in zip(cuts, [*cuts[1:], len(own)]))  # noqa: B023, E731
        best = math.inf
        for mask in range(2 ** (len(own) - 1)):
            cuts = [0, *[i for i in range(1, len(own)) if mask >> (i - 1) & 1]]
            if all(b - a <= 4 for a, b in zip(cuts, [*cuts[1:], len(own)])):
                best = min(best, cost(cuts))
        found = np.flatnonzero(starts[begin : begin + len(own)]).tolist()
        assert found[0] == 0 and max(np.diff([*found, len(own)])) <= 4 and cost(found) == pytest.approx(best)
        begin += len(own)


def test_terms_by_brute_force():
    some = [t for t in texts() if t is not None]
    hashes, sizes = lexical.terms_of(some)
    assert sizes.tolist() == [len(words(t)) for t in some]
    names = defaultdict(set)
    for h, w in zip(hashes.tolist(), (w for t in some for w in words(t))):
        names[h].add(w)
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({w for t in some for w in words(t)})
