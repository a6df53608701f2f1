"""Places of pattern matches in texts, by column functions alone.

Every match is put between two marks, the text is cut at the first mark, and the
lengths of the pieces add up to offsets in code points. Marks that a text holds
itself are replaced by another character that no pattern knows, so offsets stay.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from argloom.functions.arrays import let, sums_before

OPEN, CLOSE, NEUTRAL = "\x01", "\x02", "\x03"
NEAR = 24  # characters kept on either side of a match
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>"


def plain(text: Column) -> Column:
    """The text without marks; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.translate(text, OPEN + CLOSE, NEUTRAL * 2)).otherwise(text)


def _cut(pieces: Column, kind: str) -> Column:
    sizes = F.transform(pieces, lambda piece, i: (F.length(piece) - F.when(i > 0, 1).otherwise(0)).cast("bigint"))

    def span(piece: Column, i: Column, starts: Column) -> Column:
        value = F.substring_index(piece, CLOSE, 1)
        before = F.element_at(pieces, i)  # the piece before: places count from 1, i from 0
        return F.struct(
            F.lit(kind).alias("kind"),
            F.element_at(starts, i + 1).alias("start"),
            (F.element_at(starts, i + 1) + F.length(value)).alias("end"),
            value.alias("value"),
            F.regexp_replace(F.right(before, F.lit(NEAR)), CLOSE, "").alias("before"),
            F.left(F.substring_index(piece, CLOSE, -1), F.lit(NEAR)).alias("after"),
        )

    def spans(starts: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(pieces) - 1)
        return F.transform(places, lambda i: span(F.element_at(pieces, i + 1), i, starts))

    return let(sums_before(sizes), spans)


def find(text: Column, kind: str, pattern: str, hint: Column | None = None) -> Column:
    """All matches from left to right, none overlapping, with what stands before and after.

    ``text`` must be :func:`plain`. ``hint`` is a cheap condition without which
    there is no match; by default the pattern itself is tried first.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    found = let(pieces, lambda p: F.when(F.size(p) > 1, _cut(p, kind)))
    hint = text.rlike(pattern) if hint is None else hint
    return F.coalesce(F.when(hint, found), F.array().cast(SPAN))


def listed(spans: Column, order: list[str], by_kind: bool) -> Column:
    """``kind:start:end`` of all spans, comma-joined, by (kind, start) or by (start, kind)."""
    rank = F.create_map(*[x for k, kind in enumerate(order) for x in (F.lit(kind), F.lit(k).cast("bigint"))])

    def keyed(s: Column) -> Column:
        at = rank[s["kind"]]
        first, second = (at, s["start"]) if by_kind else (s["start"], at)
        label = F.concat_ws(":", s["kind"], s["start"], s["end"])
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"), label.alias("label"))

    return F.array_join(F.transform(F.array_sort(F.transform(spans, keyed)), lambda s: s["label"]), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans of one kind there are."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
