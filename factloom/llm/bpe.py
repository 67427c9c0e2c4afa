"""Byte-level BPE, encoded by replaying the merges over a corpus at once, and decoded.

The texts of a task are split into words on their bytes, all at once; equal words become one.
Over the distinct words an inverted index leads from each pair of neighbouring tokens to the
positions where it stands. The pair of the lowest rank is merged at all its positions, only the
pairs with the touched neighbours change their place in the index, and so on in the order of
the ranks until no pair has one. Then every text takes the tokens of its words. The corpus is
all that a task reads: texts arrive in batches, and of each batch only the words that no batch
before had are replayed, so every distinct word is merged once in a task. There is no shuffle:
what a task learns about words it needs itself.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .batches import small_batches
from .columns import col
from .text import hash_spans, slices, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are split into words before the merges; words() does the same on bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose new words are replayed together.
PIECE = 4 << 20
_SECOND = 0x2545F4914F6CDD1D

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []


@dataclass
class Vocabulary:
    """tokens by id; the id of each byte; the merges, as sorted keys (left id << 32 | right id)
    and the ids they give, which are their ranks."""

    tokens: list[bytes | None]
    of_byte: np.ndarray
    keys: np.ndarray
    merged: np.ndarray


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Reads a file of lines "base64 rank"; the rank is the token's id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    keys, merged = [], []
    for t, r in ranks.items():
        tokens[r] = t
        for i in range(1, len(t)):
            left, right = ranks.get(t[:i]), ranks.get(t[i:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                merged.append(r)
    keys_, merged_ = np.array(keys, np.int64), np.array(merged, np.int64)
    order = np.argsort(keys_)
    return Vocabulary(tokens, np.array([ranks[bytes([b])] for b in range(256)], np.int64), keys_[order], merged_[order])


def _sign_classes() -> np.ndarray:
    """The class of every code point, as the pattern's expressions see it."""
    if not _classes:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, expression in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for m in regex.finditer(expression, every):
                lo, hi = ord(m[0][0]), ord(m[0][-1])
                table[lo : hi + 1] = kind
        # a run may stretch over the gap of the surrogates, which no text holds
        _classes.append(table)
    return _classes[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words that PATTERN finds in each row of UTF-8 data, and n + 1 offsets of the rows into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[at].astype(np.int32)
    code = b.copy()
    many = np.flatnonzero(b >= 0xC0)
    if len(many):
        p, lead = at[many], b[many]
        follow = lambda k: data[np.minimum(p + k, len(data) - 1)].astype(np.int32) & 0x3F
        two, three = (lead & 0x1F) << 6 | follow(1), (lead & 0x0F) << 12 | follow(1) << 6 | follow(2)
        four = (lead & 0x07) << 18 | follow(1) << 12 | follow(2) << 6 | follow(3)
        code[many] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    kind = _sign_classes()[np.minimum(code, 0x10FFFF)]
    n = len(kind)
    first = np.zeros(n, bool)  # of a row
    heads = np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])
    first[heads] = True
    start = first.copy()
    blank = kind == BLANK
    joined = np.zeros(n, bool)  # a sign before which a single blank, taken along, stands
    joined[1:] = (code[:-1] == 32) & ~blank[1:] & ~first[1:]
    start[1:] |= (kind[1:] != kind[:-1]) & ~joined[1:]
    # the last blank of a run before a visible sign stands for itself or goes with the sign
    lasts = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:])
    start[lasts] = True
    # 's and its like: an apostrophe that begins a word, with the letters after it in the same row
    quote = np.flatnonzero((code == 39) & start & ~joined)
    if len(quote):
        row = np.cumsum(first)
        get = lambda k: np.where((quote + k < n) & (row[np.minimum(quote + k, n - 1)] == row[quote]), code[np.minimum(quote + k, n - 1)], 0)
        x, y = get(1), get(2)
        one = np.isin(x, [ord(c) for c in "stmd"])
        pair = (x == ord("r")) & (y == ord("e")) | (x == ord("v")) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        size = np.where(one, 1, np.where(pair, 2, 0))
        q, size = quote[size > 0], size[size > 0]
        start[q + 1] = False
        after = q + 1 + size
        start[q[size == 2] + 2] = False
        inner = after < n
        # what follows the letters starts anew, unless it is a sign after a blank, which they aren't
        start[after[inner]] = True
    starts = at[start]
    return starts, np.searchsorted(starts, offsets)


def replay(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all words, one after the other, and n + 1 offsets of the words into them."""
    lengths = ends - starts
    base = np.concatenate([[0], np.cumsum(lengths)])
    n = int(base[-1])
    where = np.repeat(starts - base[:-1], lengths) + np.arange(n)
    token = vocabulary.of_byte[data[where]]
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    after[base[1:][lengths > 0] - 1] = n  # the end of a word; n is a place for what isn't there
    before[base[:-1][lengths > 0]] = n
    token, after, before = np.append(token, -1), np.append(after, n), np.append(before, n)

    def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        i = np.minimum(np.searchsorted(vocabulary.keys, keys), len(vocabulary.keys) - 1)
        return np.where((vocabulary.keys[i] == keys) & (right >= 0), i, -1)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def enter(pairs: np.ndarray, positions: np.ndarray) -> None:
        """Positions join the index under their pair, given by its place among the merges."""
        known = pairs >= 0
        pairs, positions = pairs[known], positions[known]
        order = np.argsort(pairs, kind="stable")
        pairs, positions = pairs[order], positions[order]
        cut = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else []
        for lo, hi in zip(cut, [*cut[1:], len(pairs)]):
            k = int(pairs[lo])
            if k in index:
                index[k].append(positions[lo:hi])
            else:
                index[k] = [positions[lo:hi]]
                heapq.heappush(heap, (int(vocabulary.merged[k]), k))

    all_ = np.arange(n)
    enter(ranked(token[all_], token[after[all_]]), all_)
    while heap:
        rank, k = heapq.heappop(heap)
        left, right = int(vocabulary.keys[k] >> 32), int(vocabulary.keys[k] & 0xFFFFFFFF)
        lists = index.pop(k)
        p = np.concatenate(lists) if len(lists) > 1 else lists[0]
        p = p[(token[p] == left) & (token[after[p]] == right)]
        if not len(p):
            continue
        if left == right or len(lists) > 1:
            p = np.unique(p)
        if left == right:
            # of tokens in a row that are equal, the first two merge, then the next two
            chain = np.append(True, after[p[:-1]] != p[1:])
            begins = np.flatnonzero(chain)
            within = np.arange(len(p)) - np.repeat(begins, np.diff(np.append(begins, len(p))))
            p = p[within % 2 == 0]
        q = after[p]
        then = after[q]
        token[p], token[q] = rank, -2
        after[p] = then
        before[then] = p
        before[n] = after[n] = n
        token[n] = -1
        last = before[p]
        has = last < n
        enter(np.concatenate([ranked(token[p], token[then]), ranked(token[last[has]], token[p[has]])]), np.concatenate([p, last[has]]))
    alive = token[:n] >= 0
    return token[:n][alive].astype(np.int32), np.concatenate([[0], np.cumsum(alive)])[base]


class Encoder:
    """Encodes batches of texts one after the other; words that it knows aren't replayed again."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        # of each known word two independent hashes, by the first; where its tokens begin, and how many they are
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.tokens, self.filled = np.zeros(1 << 12, np.int32), 0

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, one after the other, and n + 1 offsets of the texts into them."""
        data, offsets = utf8(texts)
        begins, rows = [], [np.zeros(1, np.int64)]
        for at, n in slices(texts, 1 << 20):
            lo, hi = offsets[at], offsets[at + n]
            own, cut = words(data[lo:hi], offsets[at : at + n + 1] - lo)
            begins.append(own + lo)
            rows.append(cut[1:] + rows[-1][-1])
        starts, rows = np.concatenate([np.zeros(0, np.int64), *begins]), np.concatenate(rows)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(data))
        which = self._known(data, starts, ends)
        size = self.size[which]
        base = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        tokens = self.tokens[np.repeat(self.begin[which] - base[:-1], size) + np.arange(base[-1])]
        return tokens, base[rows]

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word among the known ones, which new words have joined."""
        a, b = hash_spans(data, starts, ends), hash_spans(data, starts, ends, _SECOND)
        order = np.argsort(a, kind="stable")
        first, second = a[order], b[order]
        if len(order) > 1 and ((first[1:] == first[:-1]) & (second[1:] != second[:-1])).any():
            order = np.lexsort((b, a))
            first, second = a[order], b[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        one, first, second = order[new], first[new], second[new]
        of_word = np.empty(len(order), np.int32)
        of_word[order] = np.cumsum(new) - 1
        place = self._find(first, second)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            at = one[fresh]
            tokens, cut = replay(self.vocabulary, data, starts[at], ends[at])
            while self.filled + len(tokens) > len(self.tokens):
                self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
            self.tokens[self.filled : self.filled + len(tokens)] = tokens
            both = [np.concatenate(x) for x in ((self.first, first[fresh]), (self.second, second[fresh]), (self.begin, self.filled + cut[:-1]), (self.size, np.diff(cut).astype(np.int32)))]
            self.filled += len(tokens)
            again = np.lexsort((both[1], both[0]))
            self.first, self.second, self.begin, self.size = (x[again] for x in both)
            place = self._find(first, second)
        return place[of_word]

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of words by their hashes, -1 for those unknown."""
        at = np.searchsorted(self.first, first)
        if not len(self.first):
            return np.full(len(first), -1)
        while True:
            # words with the same first hash stand in the order of the second
            here = np.minimum(at, len(self.first) - 1)
            further = (at < len(self.first)) & (self.first[here] == first) & (self.second[here] < second)
            if not further.any():
                return np.where((at < len(self.first)) & (self.first[here] == first) & (self.second[here] == second), here, -1)
            at = at + further


def encode_arrays(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, one after the other, and n + 1 offsets of the texts into them."""
    return Encoder(vocabulary)(texts)


def decode_tokens(vocabulary: Vocabulary, ids: list[int] | np.ndarray) -> str:
    """The text of tokens; bytes that aren't UTF-8 become U+FFFD. An unknown id is an error."""
    return b"".join([vocabulary.tokens[i] for i in ids]).decode("utf-8", "replace")


def _binary_tokens(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes, one after the other, and the offsets of the ids into them."""
    sizes = np.array([len(t or b"") for t in vocabulary.tokens])
    return np.frombuffer(b"".join(t or b"" for t in vocabulary.tokens), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def decode_arrays(pieces: tuple[np.ndarray, np.ndarray], tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many rows of tokens, and n + 1 offsets of the rows into them."""
    data, cut = pieces
    if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(cut) - 1):
        raise ValueError("a token is not in the vocabulary")
    size = np.diff(cut)[tokens]
    base = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(base[-1]), np.uint8)
    step = 1 << 20
    for lo in range(0, len(tokens), step):
        hi = min(lo + step, len(tokens))
        own = size[lo:hi]
        out[base[lo] : base[hi]] = data[np.repeat(cut[tokens[lo:hi]] - (base[lo:hi] - base[lo]), own) + np.arange(base[hi] - base[lo])]
    return out, base[offsets]


def broadcast_vocabulary(spark: SparkSession, path: str):
    """A vocabulary for the tasks; about 5 MB, whatever the data."""
    v = load_vocabulary(path)
    return spark.sparkContext.broadcast((v.tokens, v.of_byte, v.keys, v.merged))


def encode(documents: DataFrame, path: str = VOCABULARY, text_col: str = "text", id_col: str = "doc_id", verify: bool = False) -> DataFrame:
    """(doc_id, tokens, n_tokens) for every row of documents; with verify also round_trip, whether
    decoding gives back the text's very bytes.

    A null text has null tokens, n_tokens and round_trip; an empty one no tokens. A null doc_id
    stays null; repeated rows each get their row; an empty table gives an empty result. Whole
    texts are encoded, however long. Other columns are left aside, whatever their names. path
    must be readable where tasks run, or on the driver only: the vocabulary (about 5 MB) travels
    from there.
    """
    small_batches(documents.sparkSession)
    shared = broadcast_vocabulary(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*shared.value)
        encoder, pieces = Encoder(own), _binary_tokens(own)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, n in slices(texts, PIECE):
                part = texts.slice(at, n)
                tokens, off = encoder(part)
                null = part.is_null().to_numpy(zero_copy_only=False)
                count = pa.array(np.diff(off).astype(np.int32), pa.int32(), mask=null)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(tokens), mask=pa.array(null))
                out = [ids.slice(at, n), lists, count]
                if verify:
                    data, given = utf8(part)
                    back, cut = decode_arrays(pieces, tokens, off)
                    same = cut == given
                    if len(back) == len(data) and same.all():
                        wrong = np.flatnonzero(back != data)
                        good = np.ones(n, bool)
                        good[np.searchsorted(given, wrong, side="right") - 1] = False
                    else:
                        good = np.array([bytes(back[cut[i] : cut[i + 1]]) == bytes(data[given[i] : given[i + 1]]) for i in range(n)])
                    out.append(pa.array(good, mask=null))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "tokens", "n_tokens", "round_trip"][: len(out)])

    schema = "doc_id long, tokens array<int>, n_tokens int" + ", round_trip boolean" * verify
    return documents.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str = VOCABULARY, tokens_col: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) for every row of tokens: encode() undone.

    Null tokens give a null text, none an empty one; a null among them is an error, and so is an
    unknown id. Bytes that aren't UTF-8, as tokens cut out of their text may give, become U+FFFD.
    A null doc_id stays null; repeated rows each get their row; an empty table gives an empty
    result. Other columns are left aside, whatever their names.
    """
    small_batches(tokens.sparkSession)
    v = load_vocabulary(path)
    shared = tokens.sparkSession.sparkContext.broadcast(_binary_tokens(v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a token is null")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, cut = decode_arrays(shared.value, flat.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
            whole, valid = memoryview(data), lists.is_valid().to_pylist()
            text = [str(whole[cut[i] : cut[i + 1]], "utf-8", "replace") if valid[i] else None for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select(col(id_col).cast("long").alias("doc_id"), col(tokens_col).cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")
