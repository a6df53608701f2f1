"""Repair of conversation structure by weighted interval parsing.

A sound conversation reads ``(s?(ua)+)?`` in initials of roles. The repair
grammar has one nonterminal for every pair of places in that pattern, ``N[p, q]``:
whatever leads from p to q. Its rules are in Chomsky normal form, ``N[p, r] ->
N[p, q] N[q, r]`` and single turns, each with the cost and the letter of an edit;
inserted turns, which use up nothing, are a closure around every turn. A cell of
a span holds, for every nonterminal, the least (cost, audit).

As the nonterminals name both ends of what they span, every parse passes any
inner point of a span through one of them: one split per span is enough, and
spans grow by doubling, 1, 2, 4, 8 turns and so on, instead of all lengths. Of
two edits of one span at one cost neither audit begins the other (the longer one
would hold more insertions), so the least audit of the whole is made of least
audits of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The places of the pattern, what may come next there, and where it may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
PLACES = tuple(STEPS)
# What edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = "\t\n\x0b\x0c\r "
# Turns that are parsed as one table before their text is let go.
CHUNK = 512

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, at: tuple[int, int], found: tuple[int, str]) -> None:
    if at not in cell or found < cell[at]:
        cell[at] = found


def combine(left: Cell, right: Cell) -> Cell:
    """All binary rules over two spans that lie beside each other."""
    out: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for r in PLACES:
            if (q, r) in right:
                more, rest = right[q, r]
                _least(out, (p, r), (cost + more, audit + rest))
    return out


def _closure() -> Cell:
    """Insertions alone: from every place to every one that they can reach."""
    cell: Cell = {(p, p): (0, "") for p in PLACES}
    one = {(p, q): (INSERT, "I") for p, steps in STEPS.items() for role, q in steps.items() if role in ROLES}
    while True:
        grown = dict(cell)
        for at, found in combine(cell, one).items():
            _least(grown, at, found)
        if grown == cell:
            return cell
        cell = grown


INSERTIONS = _closure()


@lru_cache(maxsize=64)
def turn_cell(kind: str) -> Cell:
    """The cell of one turn, insertions on both sides included.

    ``kind`` is the initial of its role and its fault: ``-`` for one that must go,
    ``t`` for a truncated one, a blank for none.
    """
    initial, fault = kind
    cell: Cell = {}
    for p in PLACES:
        _least(cell, (p, p), (DELETE, "D"))
        if fault == "-":
            continue
        extra = TRUNCATED if fault == "t" else 0
        for role, q in STEPS[p].items():
            if role == initial:
                _least(cell, (p, q), (KEEP + extra, "K"))
            if role in ROLES:
                _least(cell, (p, q), (REROLE + extra, "R"))
    return combine(combine(INSERTIONS, cell), INSERTIONS)


@lru_cache(maxsize=1 << 12)
def span_cell(kinds: tuple[str, ...]) -> Cell:
    """The cell of a run of turns, bottom-up by span length."""
    row = [turn_cell(kind) for kind in kinds] or [INSERTIONS]
    while len(row) > 1:
        last = row[-1:] if len(row) % 2 else []
        row = [combine(a, b) for a, b in zip(row[::2], row[1::2])] + last
    return row[0]


def edited(audit: str, turns: list[tuple[str, str]], place: int) -> Iterator[str]:
    """``role:text`` of the turns that an audit leaves, starting from a place of the pattern."""
    rest = iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        if letter == "K":
            place = STEPS[place][role[:1]]
        else:
            initial, place = next((r, q) for r, q in STEPS[place].items() if r in ROLES)
            role = ROLES[initial]
        yield f"{role}:{text}"


class Conversation:
    """One conversation, turn by turn. No more than a chunk of its texts is held.

    For every place of the pattern it keeps the least (cost, audit) that leads
    there, and the hash of the text repaired that way: four of them at most.
    """

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least, self.most, self.turns = None, None, 0
        self.last: tuple | None = None
        self.ways = {START: (0, "", sha256(), True)}  # cost, audit, hash so far, nothing hashed yet
        self.chunk: list[tuple[str, str]] = []
        self.kinds: list[str] = []

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        """The next turn; ``repeated`` tells that role and text came in an earlier turn."""
        if turn is not None:
            self.turns += self.most != turn
            self.least, self.most = turn if self.least is None else self.least, turn
        bare = text.strip(BLANKS)
        fault = " "
        if not bare:
            fault = "blank"
        elif repeated or (self.last is not None and self.last == (turn, role, text)):
            fault = "duplicate"
        elif bare[-1] not in ".!?":
            fault = "truncated"
        if fault in self.counts:
            self.counts[fault] += 1
        if self.last is not None:
            self.counts["illegal"] += self.last[1][:1] + role[:1] not in LEGAL
        self.last = (turn, role, text)
        self.kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "-") + {"truncated": "t", " ": " "}.get(fault, "-"))
        self.chunk.append((role, text))
        if len(self.chunk) == CHUNK:
            self._pass_on()

    def _pass_on(self) -> None:
        """Parse the chunk and let it go. Insertions around it are part of its cell."""
        cell, ways = span_cell(tuple(self.kinds)), {}
        best: dict[int, tuple[int, str, int]] = {}
        for p, (cost, audit, _, _) in self.ways.items():
            for q in PLACES:
                if (p, q) in cell:
                    more, rest = cell[p, q]
                    found = (cost + more, audit + rest, p)
                    if q not in best or found < best[q]:
                        best[q] = found
        for q, (cost, audit, p) in best.items():
            _, before, digest, empty = self.ways[p]
            digest = digest.copy()
            for line in edited(audit[len(before) :], self.chunk, p):
                digest.update(("" if empty else "\n").encode() + line.encode("utf-8"))
                empty = False
            ways[q] = (cost, audit, digest, empty)
        self.ways, self.chunk, self.kinds = ways, [], []

    def result(self) -> tuple:
        """``gaps``, the four counts, ``cost``, ``audit`` and ``repaired_sha256``."""
        self._pass_on()
        cost, audit, digest, _ = min((self.ways[q] for q in FINAL if q in self.ways), key=lambda way: way[:2])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, *self.counts.values(), cost, audit, digest.hexdigest()


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one turn in four damaged, by a hash of conversation and turn.

    Of 20 hash values, 0 drops a turn, 1 empties its text, 2 takes its sentence
    ends, 3 repeats it and 4 makes it the user's. Nulls in role and text, and in
    what is hashed, read as one blank.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    draw = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return df.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(draw == 0, F.array()).when(draw == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))).cast("array<int>")).alias("_copy"),
    ).drop("_copy")


def repair(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """What is wrong with each conversation, and the cheapest edits that mend it.

    ``turns`` has ``conv_id, turn, role, text`` without nulls in role and text;
    ``conversations`` names further conversations in ``conv_id``. One row for
    each: those without turns have zeros, an empty audit and the hash of the empty
    string. Turns are taken in order of ``turn``, null first; turns that share a
    number go by role, then by text. A null ``conv_id`` is a conversation like any
    other. Other columns are not read; empty tables give empty ones.

    Whether role and text came in an earlier turn is found beforehand, from counts
    by hash, so that a turn repeated throughout a table is no hot group. Then each
    conversation passes through one task in order, held a chunk at a time: the
    hash of the repaired text goes from its first character to its last.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    content = F.concat_ws(":", F.length("role").cast("string"), "role", "text")
    key = [F.col("conv_id"), F.md5(content.cast("binary")).alias("_content")]
    rank = F.struct(F.col("turn").isNotNull(), F.col("turn"))  # a null turn comes before all others
    seen = turns.select(*key, rank.alias("_rank")).groupBy("conv_id", "_content")
    seen = seen.agg(F.min("_rank").alias("_first"), F.max("_rank").alias("_last")).where("_first < _last")
    seen = seen.select(F.col("conv_id").alias("_conv"), F.col("_content").alias("_seen"), "_first")
    rows = turns.withColumns({"_content": key[1], "_rank": rank})
    rows = rows.join(seen, rows["conv_id"].eqNullSafe(seen["_conv"]) & (rows["_content"] == seen["_seen"]), "left")
    rows = rows.select(
        "conv_id", F.lit(True).alias("_there"), "turn", "role", "text",
        F.coalesce(F.col("_first") < F.col("_rank"), F.lit(False)).alias("_repeated"),
    )
    # A row without a turn for each conversation, which comes first: so none is left out.
    named = conversations.select("conv_id").unionByName(turns.select("conv_id")).distinct()
    none = {"_there": F.lit(False), "turn": F.lit(None), "role": F.lit(None), "text": F.lit(None), "_repeated": F.lit(False)}
    named = named.withColumns({c: v.cast(rows.schema[c].dataType) for c, v in none.items()})
    both = named.unionByName(rows).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", "_there", F.asc_nulls_first("turn"), "role", "text")

    kind = turns.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {RESULT}"
    types = [pa.int64()] * 6 + [pa.string()] * 2
    names = ["conv_id", *[part.split()[0] for part in RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        id_type, ids, found = None, [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(ids, id_type), *[pa.array(c, t) for c, t in zip(zip(*found), types)]]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, there, turn, role, text, repeated in zip(*[c.to_pylist() for c in batch.columns]):
                if not there:
                    if now is not None:
                        found.append(now.result())
                    now = Conversation()
                    ids.append(conv)
                else:
                    now.add(turn, role, text, repeated)
            if len(found) >= 1000:
                last = ids.pop()
                yield flush()
                ids, found = [last], []
        if now is not None:
            found.append(now.result())
            yield flush()

    return both.mapInArrow(run, schema)


def repair_damaged(df: DataFrame) -> DataFrame:
    """Every conversation of a table, damaged by :func:`damage` and repaired."""
    return repair(damage(df), df)
