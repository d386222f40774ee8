"""Text preparation as plain column expressions; those with lambdas are interpreted, the others are compiled."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import PUNCTUATION, WHITESPACE

# Java class equal to Python's notion of blank: Unicode White_Space plus the
# four ASCII separators which Java leaves out.
BLANK = r"[\s\x1c-\x1f]"


def strip(col: Column) -> Column:
    """Remove blanks of any kind from both ends (no regex, linear)."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def filled(col: Column) -> Column:
    """``blank_to_null`` of a costly text: ``nullif`` computes it twice, for the comparison and for the result."""
    return let(col, lambda text: F.when(text != "", text))


def normalize_text(col: Column) -> Column:
    """Lower-case, collapse blanks, trim, and only then delete punctuation."""
    collapsed = F.regexp_replace(F.lower(col), "(?U)" + BLANK + "+", " ")
    return F.translate(F.btrim(collapsed), PUNCTUATION, "")


def _collapsed(low: Column) -> Column:
    """Blanks other than line breaks as single spaces."""
    # a table of bits tells blanks of ASCII apart; a single space stays as it is
    plain = F.regexp_replace(low, r"[\t\x0b\x0c\r\x1c\x1d\x1e\x1f ]{2,}|[\t\x0b\x0c\r\x1c\x1d\x1e\x1f]", " ")
    any_blank = F.regexp_replace(low, "(?U)[" + r"\s\x1c-\x1f" + "&&[^\n]]+", " ")
    return F.when(F.octet_length(low) == F.length(low), plain).otherwise(any_blank)


def _bare_lines(collapsed: Column) -> Column:
    tight = F.replace(F.replace(collapsed, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    punctuation = "[" + re.sub(r"(.)", r"\\\1", "".join(c for c in PUNCTUATION if c != "_")) + "_]"
    return F.split(F.regexp_replace(F.btrim(tight), punctuation, ""), "\n", -1)


def normalized_lines(col: Column) -> Column:
    """``normalize_text`` of every line, in one pass over the whole text.

    Working on the text rather than line by line keeps the work in generated
    code; only the final split makes an array.
    """
    return _bare_lines(_collapsed(F.lower(col)))


def line_steps(text: Column, out: str) -> list[dict[str, Column]]:
    """``normalized_lines`` as projections: inside lambdas the text would be lowered for each use."""
    return [{"_low": F.lower(text)}, {"_flat": _collapsed(F.col("_low"))}, {out: _bare_lines(F.col("_flat"))}]


def position(haystack: Column, needle: str, start: Column | None = None) -> Column:
    """0-based position of the first ``needle`` at or after ``start``; -1 if none."""
    from_ = F.lit(1) if start is None else start + 1
    return F.call_function("locate", F.lit(needle), haystack, from_) - 1


def window(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` for 0-based ``start``; a negative start counts as 0."""
    begin = F.greatest(start, F.lit(0))
    return F.substring(text, begin + 1, end - begin)


def contains_any(col: Column, terms) -> Column:
    """True when ``col`` holds at least one of the literal ``terms``."""
    return F.rlike(col, F.lit("|".join(re.sub(r"([^\w\s])", r"\\\1", term) for term in terms)))


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns which later steps may use often, computed exactly once.

    A filter on a plain projected column would be pushed below it together with
    a copy of the whole expression; rows of a generator are not looked through.
    The generator gets plain columns: what stands in a generator itself is interpreted where its code gets too long.
    """
    if not columns:
        return df
    made = df.withColumns({f"_bound_{name}": c for name, c in columns.items()})
    row = F.struct(*[F.col(f"_bound_{name}").alias(name) for name in columns])
    return made.select("*", F.inline(F.array(row))).drop(*[f"_bound_{name}" for name in columns])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named inside a lambda is computed again for every element;
    a one-element array holds its result instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_offset(text: Column, line_no: Column) -> Column:
    """Character offset at which line ``line_no`` (0-based) of ``text`` begins."""
    before = F.call_function("substring_index", text, F.lit("\n"), line_no)
    return F.when(line_no == 0, F.lit(0)).otherwise(F.length(before) + 1)


def chain(value: Column, *steps) -> Column:
    """``steps`` applied one after the other, each to the result of the one before, computed once.

    Types and nullability of a lambda's body are worked out again at each level around it, so a ``let`` inside a
    ``let`` doubles the time a plan takes; steps of a chain stand side by side.
    """
    row = F.array(value)
    for step in steps:
        row = F.transform(row, step)
    return F.get(row, F.lit(0))


def running_totals(numbers: Column) -> Column:
    """Sum of each element and all before it, for an array (a column or variable) without nulls.

    Each step adds what stands 1, 2, 4, ... places before, so m elements take m log m additions, and no array grows
    element by element.
    """
    doublings = F.ceil(F.log2(F.size(numbers).cast("double"))).cast("int")
    powers = F.when(F.size(numbers) > 1, F.sequence(F.lit(0), doublings - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def add(sums, power):
        return F.transform(
            sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), power)), F.lit(0))
        )

    return F.aggregate(powers, numbers, add)


def lines_with_offsets(text: Column) -> Column:
    """``array<struct<line_no, offset, line>>`` over the lines of ``text``."""
    def measured(lines):
        return F.struct(lines.alias("lines"), F.transform(lines, lambda line: F.length(line) + 1).alias("sizes"))

    def located(s):
        return F.struct(s["lines"].alias("lines"), s["sizes"].alias("sizes"), running_totals(s["sizes"]).alias("ends"))

    def numbered(s):
        return F.transform(
            s["lines"],
            lambda line, i: F.struct(
                i.alias("line_no"), (F.get(s["ends"], i) - F.get(s["sizes"], i)).alias("offset"), line.alias("line")
            ),
        )

    return chain(F.split(text, "\n", -1), measured, located, numbered)


#: Characters of one page of a text, a power of two.
PAGE_BITS = 10
PAGE = 1 << PAGE_BITS


def pages(text: Column) -> Column:
    """The text in pieces of PAGE characters: a window then costs its own length, not the text before it."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    # a short text is one page without a search; an empty one has none
    return F.when((F.octet_length(text) <= PAGE) & (text != ""), F.array(text)).otherwise(pieces)


def page_window(pages: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` for 0-based ``start`` as ``window`` gives it, from the pages of the text."""
    begin = F.greatest(start, F.lit(0))
    first = F.shiftright(begin, PAGE_BITS).cast("int")
    last = F.shiftright(F.greatest(end, begin + 1) - 1, PAGE_BITS).cast("int")
    held = F.when(first == last, F.get(pages, first)).otherwise(
        F.array_join(F.slice(pages, first + 1, last - first + 1), "")
    )
    # most texts are one page
    cut = F.when(F.size(pages) == 1, F.substring(F.get(pages, F.lit(0)), begin + 1, end - begin)).otherwise(
        F.substring(held, begin.bitwiseAND(F.lit(PAGE - 1)) + 1, end - begin)
    )
    return F.coalesce(cut, F.lit(""))
