"""Text by position: page text, layout elements, values right of a keyword.

Elements come in two shapes.  ``nearest_word`` reads an ``elements`` array kept
on the document row (no shuffle; the shape for streams and for the full
extraction).  ``nearest_word_join`` reads one row per element and never gathers
a document: keyword hits meet only the buckets with their next elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import contains_any, let, strip

ELEMENT_TYPE = "struct<page:int,elem_idx:int,text:string,x0:double,x1:double,y0:double>"
_BUCKET = V.FOLLOWING_ELEMENTS + 1


def clean_elements(elements: DataFrame) -> DataFrame:
    """Strip element texts and drop the empty ones."""
    return elements.withColumn("text", strip("text")).where(F.length("text") > 0)


def concat_pages(pages: DataFrame, key: str) -> DataFrame:
    """One text per document: its pages in order, each followed by a newline.

    NULL and empty pages go before the shuffle.  The gathered array is the
    document's own text, so it is no larger than the value it becomes.
    """
    kept = pages.where(F.length("page_text") > 0)
    in_order = F.array_sort(F.collect_list(F.struct("page", "page_text")))
    text = F.concat(F.array_join(F.transform(in_order, lambda p: p["page_text"]), "\n"), F.lit("\n"))
    return kept.groupBy(key).agg(text.alias("text"))


def _right_of(anchor, other) -> Column:
    return (
        (other["page"] == anchor["page"])
        & (F.abs(other["y0"] - anchor["y0"]) < V.LINE_TOLERANCE)
    )


def cut_at_delimiter(value: Column, delimiters) -> Column:
    """Cut at the first delimiter *of the list* which occurs; then strip."""
    cut = value
    for delimiter in reversed(delimiters):
        at = F.contains(value, F.lit(delimiter))
        cut = F.when(at, F.substring_index(value, delimiter, 1)).otherwise(cut)
    return strip(cut)


def joined_texts(elements: Column) -> Column:
    """The texts of all elements in lower case: what stands in one of them stands here too."""
    return F.lower(F.array_join(elements.getField("text"), "\n"))


def nearest_word(elements: Column, rule: dict) -> Column:
    """First elements right of a keyword, from an array in reading order."""
    keywords = [k.lower() for k in rule.get("keywords", [])]
    if rule.get("position", "right") != "right" or not keywords:
        return F.lit(None).cast("string")
    reach = rule.get("max_distance", 150)
    wanted = max(rule.get("extract_words", 1), 1)

    # one pass finds every element with any keyword; usually a handful
    texts = elements.getField("text")
    places = F.filter(
        F.transform(texts, lambda t, i: F.when(contains_any(F.lower(t), keywords), i)), lambda at: at.isNotNull()
    )
    hits = F.transform(places, lambda at: F.struct(at.alias("at"), F.lower(F.get(texts, at)).alias("low")))

    def following(e):
        after = F.slice(elements, e["at"] + 2, F.lit(V.FOLLOWING_ELEMENTS))
        near = let(
            F.get(elements, e["at"]),
            lambda anchor: F.filter(
                after, lambda o: _right_of(anchor, o) & (o["x0"] - anchor["x1"] < reach)
            ),
        )
        return F.transform(F.slice(near, 1, wanted), lambda o: o["text"])

    def by_keyword(hits):
        listed = F.array(*[F.lit(k) for k in keywords])
        return F.flatten(
            F.transform(listed, lambda k: F.filter(hits, lambda e: F.contains(e["low"], k)))
        )

    ordered = let(hits, by_keyword)
    found = F.filter(F.transform(ordered, following), lambda words: F.size(words) > 0)
    words = F.get(found, F.lit(0))
    return cut_at_delimiter(F.array_join(words, " "), rule.get("extract_until", []))


def nearest_word_join(elements: DataFrame, rules: dict[str, dict], key: str) -> DataFrame:
    """``(key, field, value)`` for every document and rule with a value.

    ``elem_idx`` must number the non-empty elements of a document densely in
    reading order.  Rows meet on (document, page, block of 20 elements), so a
    document of any size spreads over many tasks, and a block holds at most 20
    rows.  Per hit at most 19 elements are gathered.
    """
    tests = []
    for field, rule in rules.items():
        if rule.get("position", "right") != "right":
            continue
        for pos, keyword in enumerate(rule.get("keywords", [])):
            tests.append(
                F.when(
                    F.contains(F.lower("text"), F.lit(keyword.lower())),
                    F.struct(
                        F.lit(field).alias("field"),
                        F.lit(pos).alias("kw"),
                        F.lit(float(rule.get("max_distance", 150))).alias("reach"),
                        F.lit(max(rule.get("extract_words", 1), 1)).alias("wanted"),
                    ),
                )
            )
    block = F.floor(F.col("elem_idx") / _BUCKET)
    hits = (
        elements.select(
            key, "page", "elem_idx", "x1", "y0",
            F.array_compact(F.array(*tests)).alias("tests"),
        )
        .where(F.size("tests") > 0)
        .select(
            key, "page", F.col("elem_idx").alias("at"), F.col("x1").alias("hit_x1"),
            F.col("y0").alias("hit_y0"), F.inline("tests"),
        )
        .withColumn("block", F.explode(F.array(F.floor(F.col("at") / _BUCKET),
                                               F.floor(F.col("at") / _BUCKET) + 1)))
    )
    others = elements.select(
        key, "page", block.alias("block"), "elem_idx", "text", "x0", "y0"
    )
    near = hits.join(others, [key, "page", "block"]).where(
        F.col("elem_idx").between(F.col("at") + 1, F.col("at") + V.FOLLOWING_ELEMENTS)
        & (F.abs(F.col("y0") - F.col("hit_y0")) < V.LINE_TOLERANCE)
        & (F.col("x0") - F.col("hit_x1") < F.col("reach"))
    )
    per_hit = near.groupBy(key, "field", "kw", "at").agg(
        F.array_sort(F.collect_list(F.struct("elem_idx", "text"))).alias("words"),
        F.first("wanted").alias("wanted"),
    )
    joined = F.array_join(
        F.transform(F.slice("words", F.lit(1), F.col("wanted")), lambda w: w["text"]), " "
    )
    best = per_hit.groupBy(key, "field").agg(
        F.min_by(joined, F.struct("kw", "at")).alias("joined")
    )
    value = None
    for field, rule in rules.items():
        cut = cut_at_delimiter(F.col("joined"), rule.get("extract_until", []))
        is_field = F.col("field") == field
        value = F.when(is_field, cut) if value is None else value.when(is_field, cut)
    return best.select(key, "field", value.alias("value")).where(F.length("value") > 0)
