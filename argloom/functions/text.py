"""Text expressions: cleaning, sentence spans, tokens.

Everything here is a Column built from built-in functions and works inside one
row, so none of it moves data between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

from argloom.functions.arrays import let, sums_before

# The patterns that define cleaning and sentence boundaries.
TAG = r"<[^>]+>"
HTML = r"(?is)<!--.*?-->|<(script|style)\b.*?</(?:script|style)\s*>|<[^>]+>"
WHITESPACE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"
SENTENCE_END = r"""([.!?]["')\]}]*) """
ELLIPSIS = r"""\.\.["')\]}]*"""
INITIAL = r"""(?<=[\p{L}𝒜]\.)(?<![\p{L}\p{N}]\p{L}\.)(?= [\p{L};:,.!?])"""
NUMBER = r"""(?=[-.,0-9])(?<![^ ])-?[.,]?[0-9][0-9,.\-]*\.(?= [\p{Ll};:,.!?])"""
# Blanks that end no sentence. Letters are passed over by one look at the first character. The letter
# 𝒜 makes Java look back by code points; the second look back goes by UTF-16 units, as it always did.
JOINED = rf"""(?=[-.,0-9])(\.(?:(?<=\.\.)["')\]}}]*|{INITIAL})|{NUMBER}) """
TIGHT_END = r"""([.!?]["')\]}]*)(?=[(\[{*@])"""
TIGHT_JOINED = rf"""({ELLIPSIS}|(?<![\p{{L}}\p{{N}}])\p{{L}}\.)(?=[(\[{{*@])"""
NOT_A_WORD = r"[^\p{L}\p{N}]+"
# Character references: the standard's names come with Python.
ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
COMMON = ("amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "middot", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "hellip", "reg", "euro", "laquo", "raquo")
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"

SENTENCE_TYPE = "struct<text:string,start_index:bigint,end_index:bigint>"

_BREAK = "\x01"
_JOINED = "\x02"
_TIGHT = "\x03"


def _plain(text: Column) -> Column:
    """The text without the two control characters used as markers below."""
    text = F.replace(text, F.lit(_BREAK), F.lit(" "))
    return F.replace(text, F.lit(_JOINED), F.lit(" "))


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(_plain(text), WHITESPACE, " "))


def cleaned_text(col: Column) -> Column:
    """Tags to blanks, whitespace runs to one blank, trimmed. Null stays null.

    Only the part up to the last ``>`` can hold a tag. Searching no further
    keeps the time linear for texts full of stray ``<``.
    """
    text = col.cast("string")
    rest = F.substring_index(text, ">", -1)
    tagged = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
    return _squeeze(F.concat(F.regexp_replace(tagged, TAG, " "), rest))


def decoded(text: Column) -> Column:
    """Character references as the characters they stand for, in one pass from left to right.

    Named and numeric references that end in ``;`` are decoded; what is none stays.
    """
    rare = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def named(reference: Column) -> Column:
        """Looked up in a map, which is searched from its start, only if it is none of the usual ones."""
        found = F.when(reference == COMMON[0], ENTITIES[COMMON[0]])
        for name in COMMON[1:]:
            found = found.when(reference == name, ENTITIES[name])
        return found.otherwise(rare[reference])

    def character(reference: Column) -> Column:
        hexadecimal = F.lower(F.substring(reference, 1, 2)) == "#x"
        digits = F.regexp_replace(reference, "^#[xX]?", "")
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(F.substring(reference, 1, 1) == "#", F.when(valid, number)).otherwise(named(reference))

    def piece(part: Column, i: Column) -> Column:
        reference = F.regexp_extract(part, REFERENCE, 1)
        found = F.when((i > 0) & (reference != ""), character(reference))
        rest = F.substring(part, F.length(reference) + 2, F.length(part))
        return F.coalesce(F.concat(found, rest), F.when(i > 0, F.concat(F.lit("&"), part)).otherwise(part))

    joined = F.array_join(F.transform(F.split(text, "&"), piece), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def cleaned_html(col: Column) -> Column:
    """Readable text of a whole page: comments, scripts and styles dropped, references decoded.

    What opens after the last closing mark of its kind never closes. Such
    openings get a mark that keeps the pattern from searching to the end of the
    page for each of them, and only the part up to the last ``>`` is searched.
    """

    def neutral(text: Column, closing: str, opening: str, mark: str) -> Column:
        def after(head: Column) -> Column:
            tail = F.substring(text, F.length(head) + 1, F.length(text))
            return F.concat(head, F.regexp_replace(tail, opening, mark))

        return let(F.regexp_extract(text, closing, 0), after)

    def bare(text: Column) -> Column:
        rest = F.substring_index(text, ">", -1)
        tagged = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
        return F.concat(F.regexp_replace(tagged, HTML, " "), rest)

    text = let(_plain(col.cast("string")), lambda t: neutral(t, r"(?s)^.*-->", "<!--", f"<{_BREAK}!--"))
    closing = r"(?is)^.*</(?:script|style)\s*>"
    text = let(text, lambda t: neutral(t, closing, r"(?i)<(?=(?:script|style)\b)", f"<{_BREAK}"))
    text = let(text, bare)
    return _squeeze(let(F.replace(text, F.lit(_BREAK), F.lit("")), decoded))


def sentence_texts(clean: Column) -> Column:
    """Cleaned text cut into sentences, as an array of strings.

    A blank after a terminator is a break unless it follows an ellipsis, an
    initial or a number whose continuation rules it out. Such blanks are marked
    first, then the remaining ones become breaks.
    """
    marked = F.regexp_replace(clean, JOINED, f"$1{_JOINED}")
    marked = F.regexp_replace(marked, SENTENCE_END, f"$1{_BREAK}")
    marked = F.replace(marked, F.lit(_JOINED), F.lit(" "))
    return F.filter(F.split(marked, _BREAK), lambda piece: piece != "")


def _tight_pieces(clean: Column) -> Column:
    """Sentences as :func:`sentence_texts` cuts them, cut further where no blank stands.

    Pieces that end without a blank are marked by :data:`_TIGHT` at their end. What
    rules a break out is marked first, as for breaks at a blank: every terminator
    is looked at once with what stands right before and after it.
    """
    text = F.replace(clean, F.lit(_TIGHT), F.lit(" "))
    text = F.regexp_replace(text, TIGHT_JOINED, f"$1{_JOINED}")
    text = F.regexp_replace(text, TIGHT_END, f"$1{_TIGHT}{_BREAK}")
    text = F.replace(text, F.lit(_JOINED), F.lit(""))
    return F.filter(
        F.flatten(F.transform(sentence_texts(text), lambda piece: F.split(piece, _BREAK))), lambda piece: piece != ""
    )


def sentence_spans(clean: Column, tight: bool = False) -> Column:
    """Array of (text, start_index, end_index); code points from 0, end exclusive.

    With ``tight``, sentences also end where a terminator and its closing marks are
    directly followed by an opening bracket, ``*`` or ``@``, unless it ends an
    ellipsis or an initial: ``end.(Next`` is two sentences then.
    """

    def span(text: Column, start: Column) -> Column:
        return F.struct(
            text.alias("text"),
            start.alias("start_index"),
            (start + F.length(text)).alias("end_index"),
        )

    def placed(texts: Column) -> Column:
        sizes = F.transform(texts, lambda text: (F.length(text) + 1).cast("bigint"))
        return F.zip_with(texts, sums_before(sizes), span)

    def tightly_placed(pieces: Column) -> Column:
        # A mark takes one place and stands for no blank, so that is two less.
        sizes = F.transform(
            pieces, lambda p: (F.length(p) + F.when(F.endswith(p, F.lit(_TIGHT)), -1).otherwise(1)).cast("bigint")
        )
        bare = F.transform(pieces, lambda p: F.rtrim(p, F.lit(_TIGHT)))
        return F.zip_with(bare, sums_before(sizes), span)

    spans = let(_tight_pieces(clean), tightly_placed) if tight else let(sentence_texts(clean), placed)
    return F.coalesce(spans, F.array().cast(f"array<{SENTENCE_TYPE}>"))


def tokens(col: Column, max_length: int | None = None) -> Column:
    """Lower-cased words of a text, cut to ``max_length`` only when asked for."""
    text = F.lower(F.coalesce(col, F.lit("")))
    words = F.array_remove(F.split(text, NOT_A_WORD), "")
    return words if max_length is None else F.slice(words, 1, max_length)


def pair_tokens(a: Column, b: Column, max_length: int) -> tuple[Column, Column]:
    """Two word lists shortened together, always from the longer one, to ``max_length`` in all."""
    half = max_length // 2
    keep_a = F.greatest(max_length - F.size(b), F.lit(max_length - half))
    keep_b = F.greatest(max_length - F.size(a), F.lit(half))
    return F.slice(a, F.lit(1), keep_a), F.slice(b, F.lit(1), keep_b)


def contains_any(words: Column, vocabulary: Sequence[str]) -> Column:
    """Whether a word list holds one of a few given words."""
    return F.arrays_overlap(words, F.array(*[F.lit(word) for word in vocabulary]))
