"""Personal data by exact patterns and a skip-chain conditional random field.

Patterns give the base spans: e-mail addresses, IP addresses, card numbers and
telephone numbers. Every blank-separated token with a digit or an ``@`` is a node of a
document's field. Labels are the four kinds and none; a node's own potentials come
from its shape (which signs it has, how many digits), neighbouring nodes are linked
by label transitions, and nodes whose letters and digits are equal, or end in the
same seven digits, are linked however far apart they are. Loopy sum-product
message passing makes labels agree along those links: a number that is a telephone
number where it is written in full is one where it is repeated without its prefix.
Tokens that overlap base spans are held to their label.

Potentials are log-linear weights counted over all documents, with the base spans as
labels; shapes are a fixed set of 2,880, so the table is small whatever the corpus.
Nodes of a repeated form, or of repeated last digits, are linked to one group node,
not all with all, so a document costs its length; a group with held members has their
label, so that the shapes of many repeats do not add up against one full number.

Defined results: a null or empty text has no spans; long texts are read whole;
offsets are code points, ends exclusive; repeated rows are read each; of equal beliefs
the label that comes first is taken, none before the kinds; an empty table gives no rows;
other columns of any name are not read, and ``masked_documents`` keeps them.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.llm.common import documents, text_or_empty

KINDS = ("email", "ip", "card", "phone")
MASKS = {k: f"<{k.upper()}>" for k in KINDS}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9.]{7,}")
# A match can only start where a run of digits starts, and takes whole runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'.,;:!?()[]{}<>*%$&#|=-"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind, then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at and at >= last else None
        if m:
            last = m.end()
            out.append((0, start, last))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for run in _DOTTED.finditer(text):
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
                    out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """(start, end) of tokens with a digit or an ``@``, without the signs around them."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    out = []
    for m in _tokens(text):
        whole = m.group()
        core = whole.lstrip(_EDGE)
        start = m.start() + len(whole) - len(core)
        core = core.rstrip(_EDGE)
        if core:
            out.append((start, start + len(core)))
    return out


def _tokens(text: str) -> Iterator[re.Match]:
    """Tokens with a digit or ``@``, found from those signs so that a long token is read once."""
    at = 0
    while (m := _SIGN.search(text, at)) is not None:
        start = m.start()
        while start > at and not _blank(text[start - 1]):
            start -= 1
        token = _WORD.match(text, start)
        yield token
        at = token.end()


def _blank(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


#: Shapes: signs @ . - + or ( , letters, ':' or '/' (64 sets) by number of digits up to 44, in steps.
_STEPS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 24, 28, 32, 36, 40, 44])
SHAPES = 64 * 45


def shape(token: str) -> int:
    digits = sum("0" <= c <= "9" for c in token)
    signs = ("@" in token) | ("." in token) << 1 | ("-" in token) << 2 | ("+" in token or "(" in token) << 3
    signs |= any(c.isalpha() for c in token) << 4 | (":" in token or "/" in token) << 5
    return signs * 45 + int(_STEPS[np.searchsorted(_STEPS, min(digits, 44), side="right") - 1])


def labels_of(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """0 for none, else 1 + kind of the base span that each node overlaps."""
    out = np.zeros(len(found), dtype=np.int64)
    for kind, start, end in base:
        for i in range(*_overlapping(found, start, end)):
            out[i] = out[i] or kind + 1
    return out


def _overlapping(found: list[tuple[int, int]], start: int, end: int) -> tuple[int, int]:
    first = bisect.bisect_right(found, start, key=lambda x: x[1])
    return first, bisect.bisect_left(found, end, key=lambda x: x[0])


def potentials(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of (shape, label) and (label, next label), counted over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = np.zeros((SHAPES, 5), np.int64), np.zeros((5, 5), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = nodes(text)
                if found:
                    label = labels_of(found, base_spans(text))
                    np.add.at(own, ([shape(text[a:b]) for a, b in found], label), 1)
                    np.add.at(step, (label[:-1], label[1:]), 1)
        flat = np.concatenate([own.ravel(), step.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["place", "n"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most 14,425 rows
    flat = np.zeros(SHAPES * 5 + 25)
    flat[table["place"].to_numpy()] = table["n"].to_numpy()
    own, step = flat[: SHAPES * 5].reshape(SHAPES, 5), flat[SHAPES * 5 :].reshape(5, 5)
    prior = (own.sum(axis=0) + 1) / (own.sum() + 5)
    prior[0] = max(prior[0], 0.5)
    prior /= prior.sum()
    # Held at -6, so that a link to a full number can speak against the shape.
    unary = np.maximum(np.log((own + 2 * prior) / (own.sum(axis=1, keepdims=True) + 2)), -6)
    # How much likelier than by chance a label follows another; held to a factor of e.
    ratio = np.log((step + 2 * prior) / (step.sum(axis=1, keepdims=True) + 2) / prior)
    return unary, np.clip(ratio, -1, 1) / 2


#: Strength of links between equal and between similar tokens, number of sweeps, damping, belief needed.
EQUAL, SIMILAR, SWEEPS, DAMPING, BELIEF = 12.0, 9.0, 12, 0.3, 0.6
#: Shorter forms, like house numbers, say nothing about each other.
SHORTEST = 6


def _groups(tokens: list[str], held: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(what groups with held members say to each token, links of other free tokens to group nodes).

    A group is a form, or the same last seven digits. One with held members has their labels, by their share, whatever
    the others' shapes. A free token is in one group: that of its form if one is held there, or if it has fewer digits.
    """
    members: dict[tuple, list[int]] = {}
    keys: dict[int, list[tuple]] = {}
    for i, token in enumerate(tokens):
        form = "".join(c for c in token.lower() if c.isalnum())
        digits = "".join(c for c in form if "0" <= c <= "9")
        if len(form) < SHORTEST:
            continue
        keys[i] = [("form", form), ("end", digits[-7:])][: 2 if len(digits) >= 7 else 1]
        for key in keys[i]:
            members.setdefault(key, []).append(i)
    known = {key: np.bincount(held[group], minlength=5)[1:] for key, group in members.items() if len(group) > 1}
    said, links, number = np.zeros((len(tokens), 5)), [], {}
    for i in keys:
        key = keys[i][0] if keys[i][0] in known and known[keys[i][0]].any() else keys[i][-1]
        if held[i] or key not in known:
            continue
        strength, n = EQUAL if key[0] == "form" else SIMILAR, known[key]
        if n.any():
            said[i, 1:] = np.log1p(n / n.sum() * np.expm1(strength))
        else:
            links.append((i, number.setdefault(key, len(tokens) + len(number)), strength))
    return said, links


def beliefs(unary: np.ndarray, links: list[tuple[int, int, float]], step: np.ndarray) -> np.ndarray:
    """Marginals of the field by damped loopy sum-product over chain and skip links; of tokens, not of group nodes."""
    n = len(unary)
    unary = np.concatenate([unary, np.zeros((max((x[1] + 1 for x in links), default=n) - n, 5))])
    chain = np.arange(n - 1)
    a = np.concatenate([chain, np.array([x[0] for x in links], dtype=np.int64)])
    b = np.concatenate([chain + 1, np.array([x[1] for x in links], dtype=np.int64)])
    strength = np.array([x[2] for x in links])
    pair = np.concatenate([np.broadcast_to(step, (n - 1, 5, 5)), strength[:, None, None] * np.eye(5)])
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
    m = len(a)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    messages = np.zeros((2 * m, 5))
    for _ in range(SWEEPS if m else 0):
        at = unary.copy()
        np.add.at(at, target, messages)
        out = at[source] - messages[back]
        out -= out.max(axis=1, keepdims=True)
        new = np.log(np.einsum("ei,eij->ej", np.exp(out), pair) + 1e-30)
        new -= new.max(axis=1, keepdims=True)
        messages = DAMPING * messages + (1 - DAMPING) * new
    at = unary.copy()
    np.add.at(at, target, messages)
    at = np.exp(at - at.max(axis=1, keepdims=True))
    return (at / at.sum(axis=1, keepdims=True))[:n]


def all_spans(text: str, weights: tuple[np.ndarray, np.ndarray]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each by kind, then start."""
    base = base_spans(text)
    found = nodes(text)
    held = labels_of(found, base)
    if held.all():  # no node, or none that is free
        return base, base
    unary, step = weights
    tokens = [text[a:b] for a, b in found]
    own = unary[[shape(t) for t in tokens]]
    own[held > 0] = -30
    own[held > 0, held[held > 0]] = 0
    said, links = _groups(tokens, held)
    share = beliefs(own + said, links, step)
    label = share.argmax(axis=1)
    new = [(int(label[i]) - 1, *found[i]) for i in np.flatnonzero((held == 0) & (label > 0) & (share.max(axis=1) >= BELIEF))]
    return base, sorted(base + new)


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, numbers of base spans by kind, base and all spans as text."""
    held = docs.sparkSession.sparkContext.broadcast(potentials(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, base, every = np.zeros((len(KINDS), batch.num_rows), np.int64), [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                some, spans = all_spans(text, held.value)
                for kind, _, _ in some:
                    n[kind, i] += 1
                base.append(_told(some))
                every.append(_told(spans))
            names = [key, *[f"n_{k}" for k in KINDS], "base", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, n), pa.array(base, pa.string()), pa.array(every, pa.string())], names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return docs.select(key, text_or_empty().alias("text")).mapInArrow(find, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with each span, or run of overlapping spans, replaced by its (first) kind's mark."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], MASKS[KINDS[kind]]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars``, where there is one, counted anew."""
    held = docs.sparkSession.sparkContext.broadcast(potentials(docs))

    @F.pandas_udf("string")
    def masked(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: None if t is None else mask(t, all_spans(t, held.value)[1]))

    # The row is held in a struct, so that columns of any name may be there.
    rows = docs.select(F.struct("*").alias("row"), masked("text").alias("_text"))
    out = []
    for c in docs.columns:
        column = F.col("row").getField(c)
        if c == "text":
            column = F.col("_text")
        elif c == "n_chars":
            column = F.when(F.col("row.text").isNull(), column).otherwise(F.length("_text").cast(docs.schema[c].dataType))
        out.append(column.alias(c))
    return rows.select(*out)


def op2_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_spans(documents(spark, sf_dir))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
