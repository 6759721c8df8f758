"""Token ids of whole texts, with ids of words that come again kept by each Python worker."""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from functools import cache
from itertools import chain, islice

import numpy as np

#: Marks that end a word without being part of it: a run of them after a digit or a Latin letter is a token group of its own.
#: After letters that come apart when they are normalised it may not be; there it stays with its word.
_TAIL = re.compile(r"[.,!?;:%$&#*|](?<=[0-9A-Za-zÀ-ÖØ-öø-įı-ɏ].)[.,!?;:%$&#*|]*(?= |\Z)")
#: A text with others than these is not lowered as a whole: letters whose lower case depends on tables or neighbours, and marks that combine.
_OTHERS = re.compile("[^\x00-\u012f\u0131-\u024f\u2000-\u20cf]")
#: A worker keeps so many words at most (about 15 MB, which later jobs of the same worker have to do
#: without), those that two calls in a row had, and beside them only the other words of the latest call.
MAX_KEPT = 100_000


def _byte_names() -> dict[int, str]:
    """Names of bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


#: The name of each byte, in order.
_NAMES = "".join(_byte_names().get(b, chr(b)) for b in range(256))


def _plain(part: str) -> bool:
    """Latin letters only, so that case folding and the split into words are known."""
    return part.isalpha() and (part.isascii() or max(part) < "\u0250" and "\u0130" not in part)


def _words(text: str) -> list[str]:
    """Pieces of ``text`` between blanks, with marks at their ends as pieces of their own, in lower case where that is safe."""
    text = _TAIL.sub(r" \g<0>", text.replace("\n", " "))
    return (text if _OTHERS.search(text) else text.lower()).split(" ")


class WordTokens:
    """Ids of texts under a tokenizer whose words never cross a blank.

    A text is cut at spaces, line ends and marks that end words; ids of each piece are looked up, and
    pieces not seen yet are encoded together, set apart by a word of one NUL.
    Texts give the same ids as when they are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # For words that need no normalisation or split: the merges alone, on the same model in memory.
        self.merges = Tokenizer(self.tokenizer.model)
        vocabulary = self.merges.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        (self.mark,) = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self.words: dict[str, bytes] = {"": b""}
        self.latest: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words that are not known yet."""
        found: dict[str, bytes] = {}
        letters = [p for p in missing if _plain(p)]
        for i in range(0, len(letters), 2000):
            some = letters[i : i + 2000]
            # Letters hold no blank, so they are lowered and named as one string.
            names = charmap_decode(" ".join(some).lower().encode(), "strict", _NAMES)[0].split(_NAMES[0x20])
            (encoded,) = self.merges.encode_batch_fast([names], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoded.ids, dtype="<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not mark the end of words")
            found.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends))))
        rest = missing.difference(letters)
        plain = [p for p in rest if "\0" not in p]
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = self._encode(" \0 ".join(some))
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != len(some) - 1:
                raise ValueError("the tokenizer does not keep words apart")
            for part, a, b in zip(some, [-1, *ends], [*ends, len(ids)]):
                found[part] = ids[a + 1 : b].tobytes()
        for part in rest:
            if "\0" in part:
                found[part] = self._encode(part).tobytes()
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [_words(t) for t in texts]
        missing = set(chain.from_iterable(cut)).difference(self.words)
        again = {w: self.latest[w] for w in missing.intersection(self.latest)}
        self.latest = {}
        self.words.update(islice(again.items(), max(0, MAX_KEPT - len(self.words))))
        latest = again | self._learn(missing.difference(again))
        get = (self.words | latest).__getitem__
        found = [b"".join(map(get, words)) for words in cut]
        self.latest = latest
        return found


@cache
def word_tokens(path: str) -> WordTokens:
    """One per Python worker and file."""
    return WordTokens(path)


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; every executor has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)
