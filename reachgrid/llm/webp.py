"""Lossless WebP: a decoder for all of the format's tools, and an encoder.

Follows the public bitstream specification. ``decode`` reads prefix codes (simple
and normal, in groups), back-references, the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Streams of one
prefix-code group in which only green and back-references vary are read for whole
arrays: the length of the token at every bit is worked out, the places of tokens follow
by repeated doubling, and copies are made slice by slice.

``encode_samples`` stores 8-bit samples and picks the tools by what they save: a palette
for few symbols, back-references for what repeats, and, where groups of four samples
repeat, whole ARGB pixels with colour cache, predictor and cross-colour transform on trial.
"""

from __future__ import annotations

import struct
from collections import Counter
from functools import cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
ALPHABET = (256 + 24, 256, 256, 256, 40)
MAX_SIDE = 1 << 14

# Fixed values of the format: order of code-length codes, and the near pixels of distance codes 1 to 120.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


class Reader:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.count < n:
            chunk = self.data[self.at : self.at + 8]
            self.held |= int.from_bytes(chunk, "little") << self.count
            self.at += 8
            self.count += 64
        return self.held & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.held >>= n
        self.count -= n

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value

    @property
    def place(self) -> int:
        return self.at * 8 - self.count

    def move(self, place: int) -> None:
        self.at, self.held, self.count = place >> 3, 0, 0
        self.read(place & 7)


@cache
def _reversals(bits: int) -> np.ndarray:
    """Numbers of so many bits with their bits reversed."""
    out = np.zeros(1 << bits, dtype=np.int64)
    for i in range(bits):
        out |= (np.arange(1 << bits) >> i & 1) << bits - 1 - i
    return out


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as they are stored, how many); a lone symbol takes none."""
    if len(lengths) == 1:
        return {s: (0, 0) for s in lengths}
    order, sizes, bits = _in_order(lengths)
    first = np.cumsum(1 << bits - sizes) - (1 << bits - sizes)  # as codes of the full length
    return dict(zip(order.tolist(), zip(_reversals(bits)[first].tolist(), sizes.tolist())))


def _in_order(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols and lengths by length, then symbol, and the longest length."""
    symbols, sizes = np.array(list(lengths)), np.array(list(lengths.values()))
    order = np.lexsort((symbols, sizes))
    bits = int(sizes.max())
    if (1 << bits - sizes).sum() != 1 << bits:
        raise ValueError("a prefix code is not complete")
    return symbols[order], sizes[order], bits


class Code:
    """Decoding table of a prefix code."""

    def __init__(self, lengths: dict[int, int]):
        if len(lengths) == 1:
            self.bits, self.size, self.symbol = 0, np.zeros(1, np.uint8), np.array(list(lengths), dtype=np.int32)
        else:
            symbols, sizes, self.bits = _in_order(lengths)
            at, often = _reversals(self.bits), 1 << self.bits - sizes
            self.size = np.repeat(sizes, often)[at].astype(np.uint8)
            self.symbol = np.repeat(symbols, often)[at].astype(np.int32)
        self.table: list[tuple[int, int]] | None = None

    def read(self, r: Reader) -> int:
        if self.table is None:
            self.table = list(zip(self.symbol.tolist(), self.size.tolist()))
        symbol, n = self.table[r.peek(self.bits)]
        r.skip(n)
        return symbol


def _read_lengths(r: Reader, alphabet: int) -> dict[int, int]:
    if r.read(1):
        two = r.read(1)
        first = r.read(8 if r.read(1) else 1)
        return {first: 1, r.read(8): 1} if two else {first: 1}
    own = {LENGTH_ORDER[i]: n for i in range(4 + r.read(4)) if (n := r.read(3))}
    code = Code(own)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    lengths, last, at = {}, 8, 0
    while at < alphabet and left:
        left -= 1
        n = code.read(r)
        if n < 16:
            if n:
                lengths[at] = last = n
            at += 1
        elif n == 16:
            for _ in range(3 + r.read(2)):
                lengths[at] = last
                at += 1
        else:
            at += 3 + r.read(3) if n == 17 else 11 + r.read(7)
    if not lengths or max(lengths) >= alphabet:
        raise ValueError("bad code lengths")
    return lengths


def _prefix_value(r: Reader, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + r.read(extra) + 1


def _read_image(r: Reader, width: int, height: int, main: bool, used: set[str] | None = None) -> np.ndarray:
    """Coded pixels as 32-bit ARGB, in order."""
    used = set() if used is None else used
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits:
        used.add("colour cache")
    groups, bits, wide = np.zeros(1, np.int64), 0, 0
    if main and r.read(1):
        bits = r.read(3) + 2
        wide = -(-width >> bits)
        groups = (_read_image(r, wide, -(-height >> bits), False) >> 8 & 0xFFFF).astype(np.int64)
    codes = []
    for _ in range(int(groups.max()) + 1):
        sizes = [ALPHABET[0] + (1 << cache_bits if cache_bits else 0), *ALPHABET[1:]]
        codes.append([Code(_read_lengths(r, n)) for n in sizes])
    total = width * height
    if any(((c[0].symbol > 255) & (c[0].symbol < 280)).any() for c in codes):
        used.add("back-references")
    if len(codes) == 1 and not cache_bits:
        green, red, blue, alpha, distance = codes[0]
        if not (red.bits or blue.bits or alpha.bits) and green.bits + distance.bits <= _BOTH_CODES:
            rest = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(blue.symbol[0])
            return green_tokens(r, green, distance, total, width).astype(np.uint32) << 8 | np.uint32(rest)
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    cached, at = 0, 0
    while at < total:
        y, x = divmod(at, width)
        green, red, blue, alpha, distance = codes[groups[(y >> bits) * wide + (x >> bits)] if wide else 0]
        s = green.read(r)
        if s < 256:
            red_, blue_ = red.read(r), blue.read(r)
            out[at] = alpha.read(r) << 24 | red_ << 16 | s << 8 | blue_
            at += 1
        elif s < 280:
            n = _prefix_value(r, s - 256)
            d = _prefix_value(r, distance.read(r))
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at:
                raise ValueError("a back-reference starts before the image")
            for _ in range(min(n, total - at)):
                out[at] = out[at - d]
                at += 1
        else:
            # Pixels reach the cache in the order of decoding.
            while cached < at:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> 32 - cache_bits] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, dtype=np.uint32)


def _prefix_values(code: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths or distances of prefix ``code``, whose extra bits come first in ``bits``; how many extra bits)."""
    extra = np.maximum(code - 2, 0) >> 1
    base = np.where(code < 4, code, 2 + (code & 1) << extra) + 1
    return base + (bits & (np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1)).astype(np.int64), extra


def _copies_at(bits: np.ndarray, symbol: np.ndarray, size: np.ndarray, distance: Code, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, distances, bits taken) of back-references whose green code is the first of ``bits``."""
    length, extra = _prefix_values(symbol.astype(np.int64) - 256, bits >> size.astype(np.uint64))
    taken = size.astype(np.int64) + extra
    own = (bits >> taken.astype(np.uint64) & np.uint64((1 << distance.bits) - 1)).astype(np.int64)
    taken += distance.size.take(own)
    far, extra = _prefix_values(distance.symbol.take(own).astype(np.int64), bits >> taken.astype(np.uint64))
    near = np.array([max(1, dx + dy * width) for dx, dy in NEAR])
    return length, np.where(far > len(NEAR), far - len(NEAR), near[np.minimum(far, len(NEAR)) - 1]), taken + extra


def green_tokens(r: Reader, green: Code, distance: Code, total: int, width: int) -> np.ndarray:
    """``total`` green values that literals and back-references of one group give."""
    if not green.bits:
        if green.symbol[0] > 255:
            raise ValueError("a back-reference starts before the image")
        return np.full(total, green.symbol[0], dtype=np.uint8)
    held = r.data + bytes(16)
    data = np.frombuffer(held, dtype=np.uint8)
    eight = np.ndarray((len(held) - 7,), dtype="<u8", buffer=held, strides=(1,))
    out = np.empty(total, dtype=np.uint8)
    place, done, mask, copies = r.place, 0, np.uint16((1 << green.bits) - 1), bool(green.symbol.max() > 255)
    while done < total:
        # The tokens that start in a stretch of some bytes.
        first = place >> 3
        n = min(_STRETCH, len(r.data) - first)
        if n <= 0:
            raise ValueError("the stream is too short")
        part = data[first : first + n + 2].astype(np.uint32)
        word = part[:n] | part[1 : n + 1] << np.uint32(8) | part[2 : n + 2] << np.uint32(16)
        window = (word[:, None] >> _EIGHT).astype(np.uint16).ravel() & mask
        bits = len(window)
        size = green.size.take(window, mode="clip")
        if copies:
            symbol = green.symbol.take(window, mode="clip")
            far = np.flatnonzero(symbol > 255)
            length, back, taken = _copies_at(eight[first + (far >> 3)] >> (far & 7).astype(np.uint64), symbol[far], size[far], distance, width)
            size[far] = taken
        # Steps of 1, 2, 4, 8 and 16 tokens; a step out of the stretch stays at its end.
        step = np.empty(bits + 1, dtype=np.int64)
        np.add(_COUNT[:bits], size, out=step[:bits])
        np.minimum(step[:bits], bits, out=step[:bits])
        step[bits] = bits
        steps = [step]
        for _ in range(4):
            steps.append(steps[-1].take(steps[-1], mode="clip"))
        jump, starts, at = memoryview(steps.pop()), [], place & 7
        while at < bits:
            starts.append(at)
            at = jump[at]
        at = np.array(starts)
        for step in reversed(steps):
            at = np.stack([at, step.take(at, mode="clip")], axis=-1).ravel()
        at = at[at < bits]
        if copies:
            found = symbol.take(at)
            pixels = np.ones(len(at), dtype=np.int64)
            copied = np.flatnonzero(found > 255)
            which = np.searchsorted(far, at[copied])
            pixels[copied] = length[which]
            ends = done + np.cumsum(pixels)
            some = min(int(np.searchsorted(ends, total)) + 1, len(at))
            literal = np.flatnonzero(found[:some] < 256)
            out[ends[literal] - 1] = found[literal]
            for i, k in zip(copied.tolist(), which.tolist()):
                if i < some:
                    end, d = min(int(ends[i]), total), int(back[k])
                    start = int(ends[i] - pixels[i])
                    if d > start:
                        raise ValueError("a back-reference starts before the image")
                    out[start:end] = np.resize(out[start - d : min(start, start - d + end - start)], end - start)
            done = min(int(ends[some - 1]), total)
        else:
            some = min(total - done, len(at))
            out[done : done + some] = green.symbol.take(window.take(at[:some]))
            done += some
        place = first * 8 + int(at[some - 1]) + int(size[at[some - 1]])
    r.move(place)
    return out


#: A token's bits must fit 57: two codes and at most 28 extra bits.
_BOTH_CODES = 29
_STRETCH = 1 << 12
_EIGHT = np.arange(8, dtype=np.uint32)
_COUNT = np.arange(8 * _STRETCH)


def _channels(argb: np.ndarray) -> np.ndarray:
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)  # blue, green, red, alpha


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions of pixels (n, 4 channels) from their neighbours."""
    if mode == 11:
        nearer = np.abs(top - corner).sum(axis=1) < np.abs(left - corner).sum(axis=1)
        return np.where(nearer[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        # Halves are rounded towards zero.
        mean = (left + top) >> 1
        gap = mean - corner
        return np.clip(mean + (gap + (gap < 0) >> 1), 0, 255)
    pairs = {5: (((left + right) >> 1), top), 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right), 10: ((left + corner) >> 1, (top + right) >> 1)}
    if mode in pairs:
        a, b = pairs[mode]
        return (a + b) >> 1
    return {1: left, 2: top, 3: right, 4: corner}.get(mode, np.broadcast_to(_BLACK, left.shape))


_BLACK = np.array([0, 0, 0, 255])


def _guesses(at: np.ndarray, width: int, modes: np.ndarray, bits: int, done: np.ndarray) -> np.ndarray:
    """Predictions of the pixels ``at`` from those in ``done``."""
    y, x = np.divmod(at, width)
    mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, modes[y >> bits, x >> bits] & 15))
    # A row's neighbour beyond its right end is the next row's first pixel.
    left, top, right, corner = (done.take(at - k, axis=0, mode="wrap") for k in (1, width, width - 1, width + 1))
    if (mode == mode[0]).all():
        return _predict(int(mode[0]), left, top, right, corner)
    guess = np.empty((len(at), 4), dtype=np.int32)
    for m in np.unique(mode).tolist():
        own = np.flatnonzero(mode == m)
        guess[own] = _predict(m, left[own], top[own], right[own], corner[own])
    return guess


def predictor(argb: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Add (or take off) predictions; ``modes`` has a mode for each block.

    A pixel needs its left, upper left, upper and upper right neighbours, so pixels of equal x + 2y are added to at once.
    """
    height, width = argb.shape
    given = _channels(argb).reshape(-1, 4).astype(np.int32)
    if not inverse:
        out = given - _guesses(np.arange(len(given)), width, modes, bits, given)
    else:
        out = np.zeros_like(given)
        for wave in range(width + 2 * (height - 1)):
            y = np.arange(max(0, (wave - width + 2) // 2), min(height - 1, wave // 2) + 1)
            at = y * (width - 2) + wave
            out[at] = (given[at] + _guesses(at, width, modes, bits, out)) & 255
    return (out & 255).astype(np.uint8).view("<u4").reshape(height, width)


def best_modes(argb: np.ndarray, bits: int) -> np.ndarray:
    """Per block the predictor whose residuals are nearest to 0."""
    height, width = argb.shape
    shape = (-(-height >> bits), -(-width >> bits))
    costs = []
    for mode in range(14):
        rest = _channels(predictor(argb, np.full(shape, mode), bits, False)).astype(np.int64)
        cost = np.minimum(rest, 256 - rest).sum(axis=2)
        room = np.zeros((shape[0] << bits, shape[1] << bits), dtype=np.int64)
        room[:height, :width] = cost
        costs.append(room.reshape(shape[0], 1 << bits, shape[1], 1 << bits).sum(axis=(1, 3)))
    return np.argmin(costs, axis=0)


def best_factors(argb: np.ndarray, bits: int) -> np.ndarray:
    """Per block the least-squares factors of green on red, green on blue and red on blue, in 32nds."""
    height, width = argb.shape
    out = np.zeros((-(-height >> bits), -(-width >> bits), 4), dtype=np.uint8)
    for y, x in np.ndindex(*out.shape[:2]):
        blue, green, red, _ = (_channels(argb[y << bits : y + 1 << bits, x << bits : x + 1 << bits])[..., i].view(np.int8).astype(np.float64).ravel() for i in range(4))
        fit = lambda on, of: int(np.clip(np.rint(32 * (on @ of) / max(on @ on, 1)), -128, 127)) & 255
        to_red = fit(green, red)
        to_blue = fit(green, blue)
        out[y, x] = (to_red, to_blue, fit(red, blue - green * (to_blue - 256 * (to_blue > 127)) / 32), 255)
    return out.view("<u4").reshape(out.shape[:2])


def cross_colour(argb: np.ndarray, factors: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Add (or take off) what green and red say about red and blue, by block."""
    height, width = argb.shape
    c = _channels(argb).astype(np.int32)
    at = factors[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    f = _channels(np.ascontiguousarray(at))
    by = lambda i, v: (f[..., i].view(np.int8).astype(np.int32) * signed(v)) >> 5
    sign = 1 if inverse else -1
    red = c[..., 2] + sign * by(0, c[..., 1])
    blue = c[..., 0] + sign * (by(1, c[..., 1]) + by(2, red if inverse else c[..., 2]))
    out = np.stack([blue, c[..., 1], red, c[..., 3]], axis=-1) & 255
    return out.astype(np.uint8).view("<u4").reshape(height, width)


def subtract_green(argb: np.ndarray, inverse: bool) -> np.ndarray:
    c = _channels(argb).copy()
    for i in (0, 2):
        c[..., i] += c[..., 1] if inverse else np.uint8(0) - c[..., 1]
    return c.view("<u4").reshape(argb.shape)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _from_palette(coded: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    bits = _palette_bits(len(colours))
    green = (coded >> 8 & 255).astype(np.int64)
    each = 8 >> bits
    index = green[..., None] >> np.arange(1 << bits) * each & (1 << each) - 1
    table = np.zeros(256, dtype=np.uint32)
    table[: len(colours)] = colours
    return table[index.reshape(len(green), -1)[:, :width]]


def decode_stream(data: bytes, used: set[str] | None = None) -> np.ndarray:
    """ARGB pixels (height, width) of the content of a VP8L chunk; the names of its tools are put in ``used``."""
    used = set() if used is None else used
    r = Reader(data)
    if r.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    steps, wide = [], width
    while r.read(1):
        kind = r.read(2)
        used.add(("predictor", "cross-colour", "subtract-green", "palette")[kind])
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            shape = (-(-height >> bits), -(-wide >> bits))
            steps.append((kind, bits, _read_image(r, shape[1], shape[0], False).reshape(shape)))
        elif kind == PALETTE:
            colours = _channels(_read_image(r, r.read(8) + 1, 1, False))
            colours = np.cumsum(colours, axis=0, dtype=np.uint8).view("<u4").ravel()
            steps.append((kind, wide, colours))
            wide = -(-wide >> _palette_bits(len(colours)))
        else:
            steps.append((kind, 0, None))
    pixels = _read_image(r, wide, height, True, used).reshape(height, wide)
    for kind, bits, held in reversed(steps):
        if kind == PREDICTOR:
            pixels = predictor(pixels, held >> 8 & 15, bits, True)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, held, bits, True)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
        else:
            pixels = _from_palette(pixels, held, bits)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP file")
    (size,) = struct.unpack_from("<I", data, 16)
    return decode_stream(data[20 : 20 + size])


class Writer:
    """Bits, lowest first."""

    def __init__(self) -> None:
        self.value, self.count = 0, 0
        self.done: list[bytes] = []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.count
        self.count += n
        if self.count > 4096:
            whole = self.count >> 3
            self.done.append((self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.count -= 8 * whole

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes((self.count + 7) >> 3, "little")


def complete_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Code lengths up to ``most`` that fill the code space: rounded-up information, then shortened."""
    if len(counts) < 2:
        return {s: 1 for s in counts}
    total = sum(counts.values())
    order = sorted(counts, key=lambda s: (-counts[s], s))
    lengths = {s: min(most, max(1, (-(-total // counts[s]) - 1).bit_length())) for s in order}
    left = (1 << most) - sum(1 << most - n for n in lengths.values())
    for s in reversed(order):  # too many short codes: lengthen the rarest that can be
        while left < 0 and lengths[s] < most:
            lengths[s] += 1
            left += 1 << most - lengths[s]
    while left:
        for s in order:
            if lengths[s] > 1 and 1 << most - lengths[s] <= left:
                left -= 1 << most - lengths[s]
                lengths[s] -= 1
                if not left:
                    break
    return lengths


def _write_lengths(w: Writer, lengths: dict[int, int]) -> None:
    symbols = sorted(lengths)
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in symbols:
            w.put(s, 8)
        return
    w.put(0, 1)
    tokens, at = [], 0
    for s in symbols:
        gap = s - at
        while gap >= 3:
            run = min(gap, 138)
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            gap -= run
        tokens += [(0, 0, 0)] * gap + [(lengths[s], 0, 0)]
        at = s + 1
    own = complete_lengths(Counter(t[0] for t in tokens), 7)
    codes = canonical(own)
    used = max(i for i, s in enumerate(LENGTH_ORDER) if s in own)
    w.put(max(4, used + 1) - 4, 4)
    shown = LENGTH_ORDER[: max(4, used + 1)]
    w.put(sum(own.get(s, 0) << 3 * i for i, s in enumerate(shown)), 3 * len(shown))
    w.put(1, 1)  # the number of tokens follows
    n = max(2, len(tokens))
    size = max(2, (n - 2).bit_length() + (n - 2).bit_length() % 2)
    w.put((size - 2) // 2, 3)
    w.put(n - 2, size)
    for s, extra, bits in tokens:
        code, n = codes[s]
        w.put(code | extra << n, n + bits)
    if len(tokens) < 2:
        w.put(*codes[tokens[0][0]])


def _prefix_code(value: int) -> tuple[int, int, int]:
    """(code, extra bits' value, how many) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    code = 2 * high + (v >> high - 1 & 1)
    return code, v & (1 << high - 1) - 1, high - 1


def _write_image(w: Writer, pixels: np.ndarray, cache_bits: int, matches: bool, main: bool) -> None:
    """Greedy matches on runs of three pixels; one prefix-code group."""
    flat, width = pixels.ravel().tolist(), pixels.shape[1]
    near = {max(1, dx + dy * width): i + 1 for i, (dx, dy) in reversed(list(enumerate(NEAR)))}
    tokens: list[tuple] = []
    seen: dict[tuple, int] = {}
    cache: dict[int, int] = {}
    slot = lambda p: (CACHE_FACTOR * p & 0xFFFFFFFF) >> 32 - cache_bits
    at = 0
    while at < len(flat):
        key = tuple(flat[at : at + 3])
        back = seen.get(key) if matches and len(key) == 3 else None
        n = 0
        if back is not None:
            while n < 4096 and at + n < len(flat) and flat[back + n] == flat[at + n]:
                n += 1
        if n >= 3:
            d = at - back
            tokens.append(("copy", n, near.get(d, d + 120)))
        else:
            p, n = flat[at], 1
            hit = cache_bits and cache.get(slot(p)) == p
            tokens.append(("cache", slot(p)) if hit else ("pixel", p))
        for i in range(at, at + n):
            if cache_bits:
                cache[slot(flat[i])] = flat[i]
            seen[tuple(flat[i : i + 3])] = i
        at += n
    counts = [Counter() for _ in range(5)]
    for t in tokens:
        if t[0] == "pixel":
            for c, v in zip(counts, (t[1] >> 8 & 255, t[1] >> 16 & 255, t[1] & 255, t[1] >> 24)):
                c[v] += 1
        elif t[0] == "cache":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + _prefix_code(t[1])[0]] += 1
            counts[4][_prefix_code(t[2])[0]] += 1
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    lengths = [complete_lengths(c or Counter({0: 1}), 15) for c in counts]
    for x in lengths:
        _write_lengths(w, x)
    green, red, blue, alpha, distance = map(canonical, lengths)
    for t in tokens:
        if t[0] == "pixel":
            for code, v in ((green, t[1] >> 8 & 255), (red, t[1] >> 16 & 255), (blue, t[1] & 255), (alpha, t[1] >> 24)):
                w.put(*code[v])
        elif t[0] == "cache":
            w.put(*green[280 + t[1]])
        else:
            code, extra, bits = _prefix_code(t[1])
            w.put(*green[256 + code])
            w.put(extra, bits)
            code, extra, bits = _prefix_code(t[2])
            w.put(*distance[code])
            w.put(extra, bits)


def _file(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def _head(w: Writer, width: int, height: int) -> None:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("a side is 1 to 16,384 pixels")
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)


def encode(argb: np.ndarray, transforms: tuple = (), cache_bits: int = 0, matches: bool = True) -> bytes:
    """A lossless WebP file of ARGB pixels (height, width).

    ``transforms`` in order: (PREDICTOR, modes, bits), (CROSS_COLOUR, factors, bits),
    (SUBTRACT_GREEN,), (PALETTE,); a palette needs at most 256 colours.
    """
    height, width = argb.shape
    w = Writer()
    _head(w, width, height)
    pixels = argb.astype(np.uint32)
    for kind, *held in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            table, bits = held
            w.put(bits - 2, 3)
            if kind == PREDICTOR:
                pixels = predictor(pixels, table, bits, False)
                table = np.uint32(0xFF000000) | table.astype(np.uint32) << 8
            else:
                pixels = cross_colour(pixels, table, bits, False)
            _write_image(w, table, 0, False, False)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, False)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            index = index.reshape(pixels.shape)
            w.put(len(colours) - 1, 8)
            c = _channels(colours)
            _write_image(w, np.diff(c, axis=0, prepend=np.zeros((1, 4), np.uint8)).view("<u4").reshape(1, -1), 0, False, False)
            bits = _palette_bits(len(colours))
            wide = -(-pixels.shape[1] >> bits)
            room = np.zeros((height, wide << bits), dtype=np.uint32)
            room[:, : index.shape[1]] = index
            room = room.reshape(height, wide, 1 << bits) << np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits)
            pixels = np.uint32(0xFF000000) | room.sum(axis=-1).astype(np.uint32) << 8
    w.put(0, 1)
    _write_image(w, pixels, cache_bits, matches, True)
    return _file(w.bytes())


#: Longest codes of ``encode_samples``; shortest copy and furthest distance that it looks for.
_LONGEST = 12
_COPY, _FURTHEST, _MOST = 24, 1_000_000, 4096


def _packed(v: np.ndarray, n: np.ndarray, shift: int) -> bytes:
    """Tokens of ``n`` bits ``v`` in a row, from bit ``shift`` on."""
    while len(n) > 1 and 2 * int(n.max()) <= 60:  # two tokens to a number
        if len(n) % 2:
            n, v = np.append(n, np.uint64(0)), np.append(v, np.uint64(0))
        v = v[::2] | v[1::2] << n[::2]
        n = n[::2] + n[1::2]
    end = np.cumsum(n) + np.uint64(shift)
    start = end - n
    word, off = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
    out = np.zeros(int(end[-1] >> np.uint64(6)) + 2, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.add.reduceat(v << off, first)
    over = np.flatnonzero(off + n > 64)
    out[word[over] + 1] += v[over] >> (np.uint64(64) - off[over])
    return out.tobytes()[: (int(end[-1]) + 7) >> 3]


def _same(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from ``a`` and from ``b`` on are equal, up to ``most``."""
    n, step = 0, 16
    while step:
        if n + step <= most and data[a + n : a + n + step] == data[b + n : b + n + step]:
            n += step
            step *= 2
        else:
            step //= 2
    return n


def copies(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of what repeats, in order: found from equal stretches of eight samples, one in 16 places."""
    data = samples.tobytes() + bytes(8)
    if len(samples) < 2 * _COPY:
        return []
    eight = np.ndarray((len(samples) - 7,), dtype="<u8", buffer=data, strides=(1,))
    at = np.flatnonzero(eight * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60) == 0)
    key = eight[at]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    out, end = [], 0
    for place, before in sorted(zip(at[order[1:][again]].tolist(), at[order[:-1][again]].tolist())):
        if place < end or place - before > _FURTHEST:
            continue
        n = _same(data, place, before, len(samples) - place)
        while place > end and before and data[place - 1] == data[before - 1]:
            place, before, n = place - 1, before - 1, n + 1
        if n >= _COPY:
            out.append((place, n, place - before))
            end = place + n
    return out


def _tokens(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(green symbols; for those of copies the length and distance, else 0)."""
    found = copies(samples)
    if not found:
        none = np.zeros(len(samples), dtype=np.int64)
        return samples.astype(np.int64), none, none
    literal = np.ones(len(samples), dtype=bool)
    place, length, distance = [], [], []
    for at, n, d in found:
        literal[at : at + n] = False
        for k in range(0, n, _MOST):
            place.append(at + k)
            length.append(min(_MOST, n - k))
            distance.append(d)
    at = np.flatnonzero(literal)
    order = np.argsort(np.concatenate([at, place]), kind="stable")
    none = np.zeros(len(at), dtype=np.int64)
    length, distance = np.concatenate([none, length])[order], np.concatenate([none, distance])[order]
    codes = np.array([256 + _prefix_code(n)[0] for n in length[length > 0].tolist()], dtype=np.int64)
    symbol = np.concatenate([samples[at].astype(np.int64), np.zeros(len(place), np.int64)])[order]
    symbol[length > 0] = codes
    return symbol, length, distance


def _code_arrays(lengths: dict[int, int], alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(alphabet, np.uint64), np.zeros(alphabet, np.uint64)
    for s, (code, n) in canonical(lengths).items():
        codes[s], sizes[s] = code, n
    return codes, sizes


def _green_image(w: Writer, samples: np.ndarray) -> bytes:
    """The stream in ``w`` and an image whose green channel has ``samples``: literals and copies, one group of codes."""
    w.put(0, 2)  # no colour cache, one group of prefix codes
    symbol, length, distance = _tokens(samples)
    counts = np.bincount(symbol, minlength=ALPHABET[0])
    copied = np.flatnonzero(length)
    far = [_prefix_code(d + len(NEAR)) for d in distance[copied].tolist()]
    own = Counter(code for code, _, _ in far)
    some = np.flatnonzero(counts)
    lengths = complete_lengths(dict(zip(some.tolist(), counts[some].tolist())), _LONGEST)
    away = complete_lengths(own, _LONGEST) or {0: 1}
    for x in (lengths, {0: 1}, {0: 1}, {255: 1}, away):
        _write_lengths(w, x)
    codes, sizes = _code_arrays(lengths, ALPHABET[0])
    v, n = codes[symbol], sizes[symbol]
    if len(copied):
        far_codes, far_sizes = _code_arrays(away, ALPHABET[4])
        near = [_prefix_code(x) for x in length[copied].tolist()]
        for c, values, extras in (
            (None, [x[1] for x in near], [x[2] for x in near]), ([x[0] for x in far], None, None), (None, [x[1] for x in far], [x[2] for x in far]),
        ):
            value, bits = (far_codes[c], far_sizes[c]) if c is not None else (np.array(values, np.uint64), np.array(extras, np.uint64))
            v[copied] |= value << n[copied]
            n[copied] += bits
    head = w.bytes()
    if not n.any():
        return head
    shift = w.count & 7
    body = _packed(v, n, shift)
    return head[:-1] + bytes([head[-1] | body[0]]) + body[1:] if shift else head + body


def _greens(samples: np.ndarray, width: int) -> bytes:
    """Samples as green values, by way of a palette where it packs several into a pixel."""
    w = Writer()
    _head(w, width, len(samples) // width)
    some = np.flatnonzero(np.bincount(samples, minlength=256))
    bits = _palette_bits(len(some))
    if bits:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(some) - 1, 8)
        colours = np.uint32(0xFF000000) | some.astype(np.uint32) << 8
        _write_image(w, np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).view("<u4").reshape(1, -1), 0, False, False)
        index = np.searchsorted(some, samples).reshape(len(samples) // width, -1, 1 << bits)
        samples = (index << np.arange(1 << bits) * (8 >> bits)).sum(axis=-1).astype(np.uint8).ravel()
    w.put(0, 1)
    return _file(_green_image(w, samples))


#: Four samples make an ARGB pixel in images that are so wide; all others hold samples in green.
ARGB_WIDTH = 16
#: Bits of the colour cache, and the share of the green file under which ARGB pixels are expected to come to be tried.
_CACHE_BITS, _WORTH = 6, 7 / 8
_CHANNEL = np.arange(4, dtype=np.uint16) << 8


def _information(counts: np.ndarray) -> float:
    """Bits that symbols of such counts (a row per code) take at least, with about three for each symbol's code length."""
    c = counts.astype(np.float64)
    total = c.sum(axis=-1)
    return float((total * np.log2(np.maximum(total, 1))).sum() - (c * np.log2(np.maximum(c, 1))).sum() + 3 * np.count_nonzero(counts))


def _channel_counts(channels: np.ndarray) -> np.ndarray:
    return np.bincount((channels + _CHANNEL).ravel(), minlength=1024).reshape(4, 256)


def _cached_bits(argb: np.ndarray) -> float:
    """Bits of literals, where a pixel that is still in its slot of the colour cache is one symbol."""
    pixels = argb.ravel()
    slot = ((pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - _CACHE_BITS)).astype(np.uint8)
    order = np.argsort(slot, kind="stable")
    sorted_pixels = pixels[order]
    # Equal pixels have equal slots, and lie next to each other if no other came between.
    hit = np.zeros(len(pixels), dtype=bool)
    hit[order[1:][sorted_pixels[1:] == sorted_pixels[:-1]]] = True
    counts = _channel_counts(_channels(argb).reshape(-1, 4)[~hit])
    cached = np.bincount(slot[hit], minlength=256)[:256]
    first = np.concatenate([counts[1], cached])
    return _information(counts[[0, 2, 3]]) + _information(first[None])


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of the 8-bit ``samples``, row by row; ``width`` is a multiple of 8 other than 16.

    They are held as green values, or as ARGB pixels of four. Contents choose, whatever their length: from the information of
    channels, of the pixels that the colour cache does not have, and of differences to the left, ARGB pixels are tried
    as they are, or as residuals of predictors, also with cross-colour, where they promise to save an eighth; the smallest
    file is taken. What copies bring under an eighth of its samples is small enough.
    """
    best = _greens(samples, width)
    if len(samples) % (4 * ARGB_WIDTH) or len(samples) > 4 * ARGB_WIDTH * MAX_SIDE or 8 * len(best) <= len(samples):
        return best
    argb = np.ascontiguousarray(samples).view("<u4").reshape(-1, ARGB_WIDTH)
    promised = 8 * len(best) * _WORTH
    found = [best]
    if _cached_bits(argb) < promised:
        found.append(encode(argb, (), _CACHE_BITS))
    if _information(_channel_counts(np.diff(_channels(argb).reshape(-1, 4), axis=0))) < promised:
        modes = best_modes(argb, 3)
        steps = ((PREDICTOR, modes, 3), (CROSS_COLOUR, best_factors(predictor(argb, modes, 3, False), 4), 4))
        found += [encode(argb, t, _CACHE_BITS) for t in (steps[:1], steps)]
    return min(found, key=len)


def decode_samples(data: bytes) -> np.ndarray:
    """The samples of ``encode_samples``, row by row."""
    return samples_of(decode(data))


def samples_of(argb: np.ndarray) -> np.ndarray:
    """Samples that the ARGB pixels (height, width) of a file hold."""
    if argb.shape[1] == ARGB_WIDTH:
        return argb.astype("<u4").view(np.uint8).ravel()
    return (argb >> 8).astype(np.uint8).ravel()


def tools(data: bytes) -> set[str]:
    """Which of the format's tools the main image of a file uses: for reports."""
    (size,) = struct.unpack_from("<I", data, 16)
    used: set[str] = set()
    decode_stream(data[20 : 20 + size], used)
    return used
