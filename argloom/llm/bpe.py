"""Byte-level BPE: encoding, character offsets and decoding over Arrow batches.

Texts are cut into pre-tokens for a whole batch at once, by character class.
Merges never cross a pre-token, so each distinct one is encoded only once per
Python worker, by the tokenizers library, and all others are looked up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from argloom.llm.words import buffers, distinct, mix, per_row, row_groups, sums

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
# Code points that go through the arrays at once, and known pre-tokens after which the memory starts afresh.
BLOCK = 1 << 18
REMEMBERED = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(2 * BLOCK, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    points = [chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000)]
    text = "".join(points)
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, text):
            out[run.start() : run.end()] = kind
    out[0x1C:0x20] = OTHER  # the published pattern's white space is Unicode's White_Space
    return out


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(own))}
    return [rest.get(b, chr(b)) for b in range(256)]


def pretoken_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for texts that are separated by one code point at ``breaks``.

    The separators start a pre-token of their own. The rules are those of the
    published pattern: a run of letters, of numbers or of other characters,
    with one blank before it; English contractions; runs of white space, of
    which the last character is left to what follows.
    """
    kinds = character_classes()[points]
    kinds[breaks] = 0
    n = len(points)
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = kinds[1:] != kinds[:-1]
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != 0)
    after_blank = after_space.copy()
    after_blank[1:] &= points[:-1] == 0x20
    start[:n] &= ~after_blank
    start[np.flatnonzero(after_space) - 1] = True
    quote = np.flatnonzero((points == 0x27) & (kinds == OTHER))
    quote = quote[(quote + 1 < n) & ~after_blank[quote]]
    if len(quote):
        kind_before = np.where(quote > 0, kinds[quote - 1], 0)
        quote = quote[(kind_before != OTHER) & (kinds[quote + 1] == LETTER)]
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        short = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        for mask, size in ((short, 1), (long & ~short, 2)):
            start[quote[mask] + 1] = False
            start[quote[mask] + 1 + size] = True
    return np.flatnonzero(start[:n])


class ByteBpe:
    """One tokenizer file, the pre-tokens met so far, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Pre-tokens come cut and mapped already, so the library's model is asked directly; special
        # tokens are no part of it, and their strings in a text are ordinary text.
        self.model = Tokenizer.from_file(path).model
        self.mapping = dict(enumerate(byte_characters()))
        byte_of = {c: b for b, c in self.mapping.items()}
        vocabulary = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(c in byte_of for c in token):
                pieces[number] = bytes(byte_of[c] for c in token)
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.spans = np.zeros((2, 0), np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, at: np.ndarray, texts: list[str]) -> None:
        """Encode pre-tokens not met before; ``at`` is where their sorted hashes belong."""
        mapped = "\n".join(texts).encode().decode("latin-1").translate(self.mapping).split(self.mapping[10])
        if len(mapped) != len(texts):  # a pre-token holds a line end itself
            mapped = [t.encode().decode("latin-1").translate(self.mapping) for t in texts]
        found = [[token.id for token in self.model.tokenize(word)] for word in mapped]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        firsts = np.cumsum(counts) - counts + len(self.ids)
        self.known = np.insert(self.known, at, hashes)
        self.spans = np.insert(self.spans, at, np.stack([firsts, counts]), axis=1)
        self.ids = np.concatenate([self.ids, ids])

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that fit a block, and the number of ids of each."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = pretoken_starts(points, breaks)
        ends = np.append(starts[1:], len(points))
        rows = np.searchsorted(breaks, starts)
        real = starts != breaks[rows]
        starts, ends, rows = starts[real], ends[real], rows[real]
        up, down = _powers()
        if len(points) > len(up):  # one pre-token longer than a block
            up = np.cumprod(np.append(np.uint64(1), np.full(len(points), _BASE, np.uint64)))
            down = np.cumprod(
                np.append(np.uint64(1), np.full(len(points), pow(_BASE, -1, 1 << 64), np.uint64))
            )
        values = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        values = (values ^ (values >> np.uint64(29))) * up[: len(points)]
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        own, where, inverse = distinct(hashes)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, own)
        new = np.ones(len(own), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != own[inside]
        if new.any():
            spots = zip(starts[where[new]].tolist(), ends[where[new]].tolist())
            self._learn(own[new], at[new], [joined[a:b] for a, b in spots])
            at = np.searchsorted(self.known, own)
        first, count = self.spans[:, at]
        first, count = first[inverse], count[inverse]
        before = np.cumsum(count) - count
        ids = self.ids[np.repeat(first - before, count) + np.arange(int(count.sum()))]
        return ids, np.bincount(rows, weights=count, minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's range of them.

        Long texts go through in parts, cut between a letter, a blank and a
        letter, where pre-tokens are cut anyway.
        """
        parts, owners = [], []
        for row, text in enumerate(texts):
            at = 0
            while len(text) - at > BLOCK and (cut := _CUT.search(text, at + BLOCK)):
                parts.append(text[at : cut.start()])
                owners.append(row)
                at = cut.start()
            parts.append(text[at:] if at else text)
            owners.append(row)
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to]) <= BLOCK):
                size += len(parts[to]) + 1
                to += 1
            block, of_part = self._block(parts[at:to])
            ids.append(block)
            np.add.at(counts, owners[at:to], of_part)
            at = to
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows of ids, and each row's range of them.

        A character whose bytes are split over several ids comes together again,
        because bytes are joined before anything is read as characters.
        """
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        data = self.bytes[np.repeat(self.firsts[ids] - before, sizes) + np.arange(int(sizes.sum()))]
        return data, np.concatenate([[0], np.cumsum(sums(sizes, bounds))])

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last-exclusive character of every id within its row, and whether it starts
        inside a character. An id that holds part of a character spans that character whole."""
        data, rows = self.decode(ids, bounds)
        lead = (data & 0xC0) != 0x80
        seen = np.concatenate([[0], np.cumsum(lead)])  # characters that began before a byte
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        inside = ~lead[starts] if len(starts) else np.zeros(0, bool)
        base = np.repeat(seen[rows[:-1]], np.diff(bounds))
        return seen[starts] - inside - base, seen[ends] - base, inside


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Rows of a text column in ranges of about a block of bytes: first, last-exclusive, texts."""
    bounds = buffers(column)[1]
    for a, z in row_groups(bounds, BLOCK):
        yield a, z, ["" if t is None else t for t in column.slice(a, z - a).to_pylist()]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The tokenizer of a file, once per Python worker."""
    return ByteBpe(path)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, starts, ends``: ids of every text and the characters that each covers.

    Null text is treated as empty and gives empty lists. Repeated keys give one
    row each; an empty table gives an empty one; other columns are not read.
    """

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for a, z, texts in text_blocks(batch.column(1)):
                ids, bounds = bpe.encode(texts)
                starts, ends, _ = bpe.offsets(ids, bounds)
                columns = [_lists(c, bounds) for c in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), *columns], names=[key, "ids", "starts", "ends"]
                )

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<bigint>, starts array<bigint>, ends array<bigint>"
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, data``: the bytes that lists of ids stand for; a null list stands for no bytes."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            rows = [[] if r is None else r for r in batch.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            flat = np.fromiter((x for r in rows for x in r), np.int64, int(bounds[-1]))
            data, of_row = bpe.decode(flat, bounds)
            data = data.tobytes()
            out = [data[a:b] for a, b in zip(of_row[:-1], of_row[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "data"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, data binary")


def round_trip_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256, n_split`` of every text.

    Encodes and decodes again in one pass, so that token lists never leave the
    task. ``n_split`` counts ids that begin inside a character. Nulls, repeats
    and empty tables as in :func:`encode_texts`.
    """
    from hashlib import sha256

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "n_split"]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(1)):
                ids, bounds = bpe.encode(texts)
                data, of_row = bpe.decode(ids, bounds)
                ends = np.cumsum(bpe.sizes[ids])
                lead = (data & 0xC0) != 0x80
                inside = ~lead[ends - bpe.sizes[ids]] if len(ids) else np.zeros(0, bool)
                raw, data = ids.astype("<u4").tobytes(), data.tobytes()
                of_ids = [sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
                of_data = [sha256(data[a:b]).hexdigest() for a, b in zip(of_row[:-1], of_row[1:])]
                columns = [np.diff(bounds), of_ids, of_data, per_row(inside, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *map(pa.array, columns)], names=names
                )

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_split bigint"
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
