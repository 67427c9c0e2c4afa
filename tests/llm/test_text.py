"""Word boundaries and hashes on bytes against Python's own."""

import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import text

UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}&&[\p{L}\p{M}\p{N}]]"
WORD = regex.compile(rf"{UNSPACED}|(?:(?!{UNSPACED})[\p{{L}}\p{{M}}\p{{N}}_])+", regex.V1)


def words_of(row, marks=False, fold=False):
    data, off = text.utf8(pa.array([row]))
    starts, ends = text.runs(data, off, marks)
    data = text.lowered(data) if fold else data
    return [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ é!\n_9中ЖωไカÀ’—\u3000\u00a0😀𐐀", max_size=20), st.text(max_size=8)), max_size=8))
def test_words_match_python(rows):
    hashes, off = text.word_hashes(pa.array(rows, pa.string()), fold=False)
    known = {}
    for i, row in enumerate(rows):
        words = WORD.findall(row or "")
        assert off[i + 1] - off[i] == len(words) and (row is None or words_of(row) == words)
        for w, h in zip(words, hashes[off[i] : off[i + 1]]):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_case_folds_in_every_script():
    a, _ = text.word_hashes(pa.array(["ÀÉ Word МИР ΩΜΈΓΑ", "àé wORD мир ωμέγα"]))
    assert list(a[:4]) == list(a[4:])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_lower_case_keeps_every_place(row):
    data, _ = text.utf8(pa.array([row]))
    fold = lambda c: c.lower() if regex.match(r"[\p{Lu}\p{Lt}]", c) and len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else c
    assert bytes(text.lowered(data)).decode() == "".join(map(fold, row))


def test_scripts_without_blanks():
    assert words_of("日本語、abc漢字 ไทย") == ["日", "本", "語", "abc", "漢", "字", "ไ", "ท", "ย"]
    assert words_of("don’t—«Ünï» a\u00a0b", marks=True, fold=True) == ["don", "’", "t", "—«", "ünï", "»", "a", "b"]


def test_long_words_and_slices():
    long = "x" * (text.PIECE * 2 + 5)
    array = pa.array(["pad", long + " b", None, ""]).slice(1)
    hashes, off = text.word_hashes(array)
    assert off.tolist() == [0, 2, 2, 2]
    again, _ = text.word_hashes(pa.array([long]))
    assert hashes[0] == again[0]
    assert [x for x in text.slices(array, 4)] == [(0, 1), (1, 2)] or sum(n for _, n in text.slices(array, 4)) == 3


def test_marks_are_words_too():
    _, off = text.word_hashes(pa.array(["a!! b??c", " "]), marks=True)
    assert np.diff(off).tolist() == [5, 0]
