"""Byte-level BPE against the published rank file, and packing."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from argloom.llm import bpe, packing
from conftest_llm import ROWS, rows_of

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = st.sampled_from(
    ["a", "bc", "s", "t", "re", "ll", "'", "'s", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "1", "½", "é", "漢", "😀", "!", "<|endoftext|>", "\0"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=1, max_size=4))
def test_encode_equals_the_rank_file(reference, texts):
    codec = bpe.load(PATH)
    ids, bounds = codec.encode(texts)
    data, of_row = codec.decode(ids, bounds)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == reference.encode_ordinary(text)
        assert data[of_row[k] : of_row[k + 1]].tobytes().decode() == text


def test_every_code_point_has_the_class_of_the_published_pattern(reference):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"a{chr(c)}1!{chr(c)}!" for c in points]
    ids, bounds = bpe.load(PATH).encode(texts)
    ids = ids.tolist()
    assert all(ids[bounds[k] : bounds[k + 1]] == reference.encode_ordinary(t) for k, t in enumerate(texts))


def test_long_texts_go_through_in_parts(reference, monkeypatch):
    text = "word after word, and 12 more\n" * 300
    monkeypatch.setattr(bpe, "BLOCK", 500)
    ids, _ = bpe.ByteBpe(PATH).encode([text, "", text])
    assert ids.tolist() == reference.encode_ordinary(text) * 2


def test_offsets_cover_whole_characters():
    codec = bpe.load(PATH)
    text = "né 😀 漢x"
    ids, bounds = codec.encode([text])
    starts, ends, inside = codec.offsets(ids, bounds)
    for number, a, z, part in zip(ids, starts, ends, inside):
        piece = codec.decode(np.array([number]), np.array([0, 1]))[0].tobytes()
        cover = text[a:z].encode()
        assert piece in cover
        assert not part or cover != piece
    assert inside.any() and starts[0] == 0 and ends[-1] == len(text)


def test_operators_on_awkward_rows(spark, awkward, nothing, reference):
    got = sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in bpe.encode_texts(awkward, PATH).collect())
    assert got == sorted((i or -1, tuple(reference.encode_ordinary(t or ""))) for i, t, _, _ in ROWS)
    back = bpe.decode_ids(bpe.encode_texts(awkward, PATH), PATH).collect()
    assert sorted(bytes(r["data"]) for r in back) == sorted((t or "").encode() for _, t, _, _ in ROWS)
    assert bpe.encode_texts(nothing, PATH).count() == 0
    assert bpe.decode_ids(spark.createDataFrame([(1, None)], "doc_id int, ids array<bigint>"), PATH).first()["data"] == b""


def test_digests(documents, texts, reference):
    got = rows_of(bpe.round_trip_digests(documents, PATH))
    assert len(got) == len(texts)
    for key, text in texts.items():
        ids = reference.encode_ordinary(text)
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def check_packing(rows, ids_of, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for key, ids in ids_of.items():
        at = 0
        for number, r in enumerate(sorted(pieces[key], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (number, at)
            assert number == 0 or len(ids) <= capacity or r["length"] == capacity
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(pieces[key]) == 1)
    return len(sequences)


def test_packing_of_the_smallest_table(documents, texts, reference):
    rows = packing.pack_documents(documents, PATH).collect()
    ids_of = {k: reference.encode_ordinary(t) + [2] for k, t in texts.items()}
    used = check_packing(rows, ids_of, 1024)
    least = -(-sum(map(len, ids_of.values())) // 1024)
    assert used <= least + 2


def test_packing_of_awkward_rows(awkward, nothing, reference):
    unique = awkward.where("doc_id IS NOT NULL AND doc_id <> 12")
    rows = packing.pack_documents(unique, PATH, capacity=16, with_ids=True).collect()
    ids_of = {i: reference.encode_ordinary(t or "") + [2] for i, t, _, _ in ROWS if i not in (None, 12)}
    check_packing(rows, ids_of, 16)
    assert all(r["length"] == len(r["ids"]) for r in rows)
    assert packing.pack_documents(awkward, PATH).where("doc_id IS NULL OR doc_id = 12").count() == 3
    assert packing.pack_documents(nothing, PATH).count() == 0


def optimal(lengths, capacity):
    """Fewest sequences, by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                go(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
        go(k + 1, rooms + [capacity - lengths[k]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimal_packing(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    fixed, rest = packing.reduce_counts(counts, 20)
    left = [x for x, n in rest.items() for _ in range(n)]
    for parts, n in fixed:
        assert sum(x * k for x, k in parts) <= 20 and n > 0
    placed = sum(n * k for parts, n in fixed for _, k in parts)
    assert placed + len(left) == len(lengths)
    assert sum(n for _, n in fixed) + optimal(left, 20) == optimal(lengths, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=8))
def test_slots_place_every_piece_once(counts):
    slots = packing.plan_slots(counts, 30)
    filled = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            row = [s for s in slots if s[0] == length and s[1] <= rank][-1]
            nth = rank - row[1]
            filled[row[2] + nth // row[3]].append((row[4] + nth % row[3] * length, length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30
