"""Vectorised scanning of UTF-8 text in Arrow buffers: word boundaries and 64-bit word hashes.

Everything here works on the raw bytes of a string array, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_POLY = 0x5851F42D4C957F2D
#: Bytes of text hashed at once; the temporaries of one piece stay in the processor's cache.
PIECE = 1 << 18

SPACE, WORD, MARK, ALONE = 0, 1, 2, 3
#: Signs of scripts that put no blanks between words; each is a word of its own.
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}&&[\p{L}\p{M}\p{N}]]+"


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0]] = SPACE
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        kinds[lo:hi] = WORD
    kinds[95] = WORD
    return kinds


KINDS = _byte_classes()
_tables: list[np.ndarray] = []


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its class, and its lower case where that is as long in UTF-8."""
    if not _tables:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        at = lambda m: slice(ord(m[0][0]), ord(m[0][-1]) + 1)
        kinds, lower = np.full(0x110000, MARK, np.uint8), np.arange(0x110000, dtype=np.int32)
        # a run may stretch over the gap of the surrogates, which no text holds
        for kind, expression in ((WORD, r"[\p{L}\p{M}\p{N}]+"), (SPACE, r"[\s\p{Z}\p{C}&&[^\p{Co}]]+"), (ALONE, _UNSPACED)):
            for m in regex.finditer(expression, every, regex.V1):
                kinds[at(m)] = kind
        for c in regex.findall(r"[\p{Lu}\p{Lt}]", every):
            low = c.lower()
            if len(low) == 1 and len(low.encode()) == len(c.encode()):
                lower[ord(c)] = ord(low)
        _tables.extend((kinds, lower))
    return _tables[0], _tables[1]


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points whose UTF-8 begins at the given bytes, all of 0xC0 or more, and their lengths."""
    lead = data[at].astype(np.int32)
    follow = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int32) & 0x3F
    two, three = (lead & 0x1F) << 6 | follow(1), (lead & 0x0F) << 12 | follow(1) << 6 | follow(2)
    four = (lead & 0x07) << 18 | follow(1) << 12 | follow(2) << 6 | follow(3)
    size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
    return np.minimum(np.where(size == 2, two, np.where(size == 3, three, four)), 0x10FFFF), size


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    """mix() of one Python integer."""
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: int = _POLY) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(PIECE + 4096, n) + 1
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            t = np.full(size, b, U64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U64))
        have = _powers[base] = (tables[0], tables[1])
    return have


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its rows; a null row is empty."""
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not (wide or pa.types.is_string(array.type) or pa.types.is_binary(array.type)):
        array = array.cast(pa.string())
        wide = False
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case, but for letters whose lower case is of another length in UTF-8."""
    out = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        code, size = code_points(data, at)
        low = _code_tables()[1][code]
        changed = low != code
        at, low, size = at[changed], low[changed], size[changed]
        for n, lead in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
            own = size == n
            p, c = at[own], low[own]
            for k in range(n):
                out[p + k] = (lead if k == 0 else 0x80) | (c >> 6 * (n - 1 - k)) & (0xFF if k == 0 else 0x3F)
    return out


def runs(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words (and with marks=True of runs of other visible signs), cut at rows.

    A word is a run of letters, combining signs, digits and underscores of any script; of
    scripts without blanks between words each sign is one.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = KINDS[data]
    alone = np.zeros(0, np.int64)
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        code, size = code_points(data, at)
        own = _code_tables()[0][code]
        alone = at[own == ALONE]
        own = np.where(own == ALONE, WORD, own)
        for k in range(4):
            kinds[at[size > k] + k] = own[size > k]
    if not marks:
        kinds = (kinds == WORD).astype(np.uint8)
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    firsts = offsets[:-1]
    edge[firsts[firsts < len(data)]] = True
    if len(alone):
        edge[alone] = True
        after = alone + np.where(data[alone] < 0xE0, 2, np.where(data[alone] < 0xF0, 3, 4))
        edge[after[after < len(data)]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], len(data))
    seen = kinds[at] != SPACE
    return at[seen], ends[seen]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _POLY) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial in base modulo 2**64."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + PIECE, side="right"))
        j = max(j, i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(hi - lo, base)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(_MULT))


def word_hashes(array: pa.Array, marks: bool = False, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and the n + 1 offsets of its rows into them."""
    data, offsets = utf8(array)
    starts, ends = runs(data, offsets, marks)
    hashes = hash_spans(lowered(data) if fold else data, starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def slices(array: pa.Array, most: int = 4 << 20):
    """Consecutive (start, length) pieces of a string array of about most bytes, a row at least."""
    n = len(array)
    if not n:
        return
    lengths = np.asarray(array_lengths(array))
    ends = np.cumsum(lengths)
    i = 0
    while i < n:
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield i, j - i
        i = j


def array_lengths(array: pa.Array) -> np.ndarray:
    """Bytes of each row of a string array; 0 for a null."""
    _, offsets = utf8(array)
    return np.diff(offsets)
