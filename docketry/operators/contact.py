"""Plaintiff contact block: trigger line, 500-character window, cleaning.

Exact triggers are found with plain string search.  Only lines which could
still reach the similarity threshold (by length and by shared letter pairs, both
exact bounds) go to the one Python function of this package.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.compiled import compiled
from ..functions.text import (
    bind,
    blank_to_null,
    contains_any,
    let,
    line_offset,
    line_steps,
    position,
    strip,
)


def normalize_phrase(phrase: str) -> str:
    """Driver-side twin of ``functions.text.normalize_text`` for trigger phrases."""
    return " ".join(phrase.lower().split()).translate({ord(c): None for c in V.PUNCTUATION})


def clean_contact(window: Column, keep_blank: bool = False) -> Column:
    """Drop lines with a remove term, then stop at the first cutoff term; NULL if empty."""
    lines = F.split(window, "\n", -1)
    if not keep_blank:
        lines = F.filter(F.transform(lines, strip), lambda x: F.length(x) > 0)
    lowered = F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    kept = F.filter(lowered, lambda x: ~contains_any(x["low"], V.CONTACT_REMOVE_TERMS))

    def until_cutoff(kept):
        cuts = F.transform(kept, lambda x: contains_any(x["low"], V.CONTACT_CUTOFF_TERMS))
        at = F.array_position(cuts, F.lit(True)).cast("int")
        return F.when(at > 0, F.slice(kept, F.lit(1), at - 1)).otherwise(kept)

    cut = let(kept, until_cutoff)
    return blank_to_null(F.array_join(F.transform(cut, lambda x: x["line"]), "\n"))


def contact_at(text: Column, index: Column) -> Column:
    return clean_contact(F.substring(text, index + 1, F.lit(V.CONTACT_WINDOW)))


def add_exact_trigger(
    df: DataFrame, text: str, phrases, ignore_case: bool, bound: bool = True
) -> DataFrame:
    """Add ``_line`` and ``_index`` of the first line with a phrase; NULL without one.

    Within that line the first phrase *of the list* gives the position.  The
    steps are separate projections, so the text is searched once per phrase.
    """
    steps = compiled(
        ("trigger", text, tuple(phrases), ignore_case),
        lambda: _trigger_steps(F.col(text), phrases, ignore_case),
    )
    for columns in steps[:-1]:
        df = df.withColumns(columns)
    df = bind(df, steps[-1]) if bound else df.withColumns(steps[-1])
    return df.drop("_hay", "_first", "_before", "_after", "_whole", "_line_no")


def _trigger_steps(body: Column, phrases, ignore_case: bool) -> list[dict[str, Column]]:
    needles = [p.lower() if ignore_case else p for p in phrases]

    def places(hay):
        return [F.when(F.contains(hay, F.lit(n)), position(F.col(hay), n)) for n in needles]

    breaks = F.length("_before") - F.length(F.replace("_before", F.lit("\n"), F.lit("")))
    return [
        {"_hay": F.lower(body) if ignore_case else body},
        {"_first": F.array_min(F.array(*places("_hay")))},
        {
            "_before": F.substring("_hay", F.lit(1), F.col("_first")),
            "_after": F.substring("_hay", F.col("_first") + 1, F.lit(2**31 - 1)),
        },
        {
            "_line_no": breaks,
            "_whole": F.concat(
                F.substring_index("_before", "\n", -1), F.substring_index("_after", "\n", 1)
            ),
        },
        {
            "_line": F.col("_line_no"),
            "_index": line_offset(body, F.col("_line_no")) + F.coalesce(*places("_whole")),
        },
    ]


def may_be_similar(line: str, phrase: str, size: str | None = None) -> str:
    """SQL condition on column ``line``, exact and necessary for ``ratio(phrase, line) > 0.8``; ``size`` is its length, if known.

    With a and b characters and M matched ones, ratio = 2M/(a+b).  M <= min(a, b)
    bounds the length.  At most a+b-2M characters stay unmatched, so the matches
    form at most a+b-2M+1 runs, which hold at least 3M-(a+b)-1 > 0.2(a+b)-1
    letter pairs of the phrase.
    """
    size = size or f"length({line})"
    a = len(phrase)
    limit = V.FUZZY_TRIGGER_RATIO
    low, high = a * limit / (2 - limit), a * (2 - limit) / limit
    pairs = Counter(phrase[i : i + 2] for i in range(a - 1))
    # one mark for each pair that is there: cheaper inside lambdas than a long sum
    marks = ", ".join(f"if(contains({line}, '{p}'), '{'x' * n}', '')" for p, n in pairs.items())
    needed = f"{1.5 * limit - 1}D * ({size} + {a}) - 1"
    return f"({size} > {low}D AND {size} < {high}D AND octet_length(concat({marks})) >= {needed})"


def similarity_udf(phrases):
    """First line of a list which is similar to a phrase (0-based), else -1."""
    wanted = [normalize_phrase(p) for p in phrases]
    limit = V.FUZZY_TRIGGER_RATIO

    def similar(line: str) -> bool:
        for phrase in wanted:
            matcher = SequenceMatcher(None, phrase, line)
            if matcher.quick_ratio() > limit and matcher.ratio() > limit:
                return True
        return False

    @F.pandas_udf("int")
    def first_similar(lists: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def first(lines):
            for i, line in enumerate(lines if lines is not None else ()):
                if line not in known:
                    known[line] = similar(line)
                if known[line]:
                    return i
            return -1

        return lists.map(first).astype("int32")

    return first_similar


def add_contact(
    df: DataFrame,
    text: str,
    out: str,
    *,
    phrases=V.BATCH_TRIGGERS,
    ignore_case: bool = True,
    fuzzy: bool = True,
    bound: bool = True,
) -> DataFrame:
    """Add the contact block of ``text`` as column ``out``.

    ``bound`` keeps later filters on it above the search; without it the search is pruned where nothing reads it.

    Contact texts are cut before the Python step, so whole documents never
    travel through it.
    """
    step = add_exact_trigger(df, text, phrases, ignore_case, bound)
    exact, numbered, near, pieces = compiled(
        ("contact", text, tuple(phrases)), lambda: _contact_steps(F.col(text), phrases)
    )
    step = step.withColumns(exact)
    if not fuzzy:
        return step.withColumn(out, F.col("_exact")).drop("_line", "_index", "_exact")
    for columns in compiled(("lines", text), lambda: line_steps(F.col(text), "_lines")):
        step = step.withColumns(columns)
    step = step.withColumns(numbered).withColumns(near).drop("_numbered", "_lines", "_low", "_flat")
    step = step.withColumns(pieces)
    step = step.withColumn("_hit", similarity_udf(phrases)("_near_lines"))
    return step.withColumn(
        out,
        F.when(F.col("_hit") >= 0, F.get("_near_contacts", F.col("_hit"))).otherwise(
            F.col("_exact")
        ),
    ).drop("_line", "_index", "_exact", "_near", "_near_lines", "_near_contacts", "_hit")


def _contact_steps(body: Column, phrases) -> list[dict[str, Column]]:
    # what stands at or after the exact trigger can no longer be the first
    before = F.when(F.col("_line").isNull(), F.col("_lines")).otherwise(F.slice("_lines", F.lit(1), F.col("_line")))
    numbered = F.transform(before, lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.length(x).alias("size")))
    tests = " OR ".join(may_be_similar("n.line", normalize_phrase(p), "n.size") for p in phrases)
    possible = F.expr(f"filter(_numbered, n -> {tests})")
    return [
        {"_exact": contact_at(body, F.col("_index"))},
        {"_numbered": numbered},
        {"_near": possible},
        {
            "_near_lines": F.transform("_near", lambda n: n["line"]),
            "_near_contacts": F.transform(
                "_near", lambda n: contact_at(body, line_offset(body, n["at"]))
            ),
        },
    ]


def add_strict_contact(df: DataFrame, text: str, out: str, **kw) -> DataFrame:
    """Two phrases, case kept."""
    return add_contact(df, text, out, phrases=V.STRICT_TRIGGERS, ignore_case=False, **kw)


def override_contact(strict: Column, batch: Column) -> Column:
    return F.coalesce(strict, batch)
