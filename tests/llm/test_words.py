"""Hashing of words and Elias-Fano sequences against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from argloom.llm import words as W
from argloom.llm.eliasfano import EliasFano

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def found_words(texts, **options):
    data, bounds = W.buffers(pa.array(texts, pa.string()))
    return data, W.words(data, bounds, **options)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0béß漢\x1c", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, found = found_words(texts)
    got = [bytes(data[a:z]).decode() for a, z in zip(found.starts, found.ends)]
    assert got == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(found.bounds).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert len(set(found.hashes.tolist())) == len(set(got))


def test_hash_does_not_depend_on_place_or_block(monkeypatch):
    long = "y" * 1000
    _, whole = found_words([f"a {long} b", long])
    monkeypatch.setattr(W, "BLOCK", 64)
    _, cut = found_words([f"a {long} b", long])
    assert whole.hashes.tolist() == cut.hashes.tolist()
    assert whole.hashes[1] == whole.hashes[3]


def test_folding_touches_ascii_only():
    _, found = found_words(["ÄB äB Äb äb"], fold=True)
    h = found.hashes.tolist()
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_windows_stay_inside_rows():
    _, found = found_words(["a b c", "a b", "x a b c"])
    keys, bounds = W.windows(found, 3)
    assert np.diff(bounds).tolist() == [1, 0, 2]
    assert keys[0] == keys[2]


@pytest.mark.parametrize("n, universe", [(0, 5), (1, 1), (50, 60), (300, 1 << 62), (5000, 5000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    code = EliasFano.encode(values, universe)
    assert code.decode().tolist() == values.tolist()
    asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
    place, equal = code.successor(asked)
    assert place.tolist() == np.searchsorted(values, asked).tolist()
    assert equal.tolist() == np.isin(asked, values).tolist()
