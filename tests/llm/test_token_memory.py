"""What a worker's tokenizer keeps between calls, and that texts lowered and cut as a whole give the same ids."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from reachgrid.llm import packing, tokens
from reachgrid.llm.tokens import WordTokens, public_path


@pytest.fixture(scope="module")
def path():
    return public_path("word_bpe_49k.json")


def whole(t: WordTokens, text: str) -> list[int]:
    return t.tokenizer.encode(text, add_special_tokens=False).ids


def word(r: random.Random) -> str:
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=14))


def test_rare_words_are_not_kept(path):
    """400,000 words of which each is met once: the worker keeps those of its latest call."""
    t, r = WordTokens(path), random.Random(3)
    t.ids(["a few words"])
    tracemalloc.start()
    for _ in range(40):
        t.ids([" ".join(word(r) for _ in range(10_000))])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 10e6


def test_words_that_come_again_are_kept_up_to_the_limit(path, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_KEPT", 50)
    t, r = WordTokens(path), random.Random(4)
    common = [word(r) for _ in range(100)]
    for _ in range(5):
        text = " ".join([*common, *(word(r) for _ in range(30)), *common])
        assert np.frombuffer(t.ids([text])[0], "<u4").tolist() == whole(t, text)
        assert len(t.words) <= 50
    assert len(t.words) == 50 and set(t.words) <= {"", *common}


def test_every_letter_that_is_lowered_gives_the_same_ids(path):
    t = WordTokens(path)
    letters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x20D0)]]
    texts = [form.replace("@", c) for c in letters for form in ("@", "Ab@C", "X1@Y, @.", "@@!! A@.")] + ["aΣ. ΑΣ, B", "İX, I.", "K. ÉA,"]
    for text, ids in zip(texts, t.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(t, text), repr(text)


def test_marks_after_any_letter_give_the_same_ids(path):
    """Some letters come apart into a letter and a mark, which joins the marks after it."""
    t = WordTokens(path)
    texts = [f"a{c}, {c}." for c in map(chr, range(0x250, 0x10000)) if c.isalnum()]
    for text, ids in zip(texts, t.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(t, text), repr(text)


def test_marks_at_the_end_of_words_give_the_same_ids(path):
    t, r = WordTokens(path), random.Random(5)
    pieces = ["a", "Bc", "É", "9", "_", "'s", "’", ".", ",", "!", "?", ";", ":", "%", "$", "&", "#", "*", "|", "-", ")", " ", " ", "\n", "\t", "\0", "\r", " ", " ", "一"]
    texts = ["".join(r.choices(pieces, k=r.randint(1, 12))) for _ in range(6000)]
    for text, ids in zip(texts, t.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(t, text), repr(text)


def test_slices_count_code_points_and_leave_out_no_row(monkeypatch):
    monkeypatch.setattr(packing, "_CHARS", 10)
    texts = ["é" * 9, "a", "", "b" * 30, "", "c"]
    sizes = pa.compute.utf8_length(pa.array(texts)).to_pylist()
    assert list(packing._slices(sizes)) == [(0, 2), (2, 4), (4, 6)]
