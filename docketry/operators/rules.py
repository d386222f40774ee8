"""Field rules: each rule of a pack becomes one Column when the plan is built.

A rule type is a function ``(rule, doc) -> Column``.  ``doc`` names the columns
of the current document.  ``register_rule_type`` adds types of your own.
All types work on one row at a time, so a whole pack is one narrow projection.

Rules share what they ask of a text.  Words that a pattern cannot do without are looked up once
per document, dates of the usual shapes are searched and located once; a rule
scans a text by its own pattern only where all of that is there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import regex as R
from ..functions.dates import date_parts, from_parts, is_padded_numeric
from ..functions.text import blank_to_null, chain, filled, let, page_window, pages, position, strip, window
from .layout import nearest_word


@dataclass(frozen=True)
class Shared:
    """What all rules of a plan ask of a text: word sets, and shapes of dates.

    A set of words is true where one of them occurs; a shape is a local pattern, its spans are located once.
    """

    words: tuple[tuple[str, ...], ...] = ()
    shapes: tuple[str, ...] = ()

    def columns(self) -> list[dict[str, Column]]:
        """Steps over ``_text`` and ``_lower``; later ones use earlier ones."""
        # letters that equal an ASCII one when case is ignored, where there are any
        folded = F.translate(F.col("_lower"), "\u0131\u017f\u0307", "is")
        plain = F.when(F.octet_length("_lower") == F.length("_lower"), F.col("_lower")).otherwise(folded)
        steps = [{"_plain": plain, "_pages": pages(F.col("_text"))}, {f"_word{i}": _any_of(F.col("_plain"), words) for i, words in enumerate(self.words)}, {}, {}, {}, {}, {}]
        for i, shape in enumerate(self.shapes):
            asked = [self.word(words) for words in _asked(shape) if words in self.words]
            pieces, (measured, located, spans) = R.span_steps(F.col("_text"), shape, i)
            steps[2][f"_shape{i}"] = _all([*asked, R.matches(F.col("_text"), shape)])
            steps[3][f"_pieces{i}"] = F.when(F.col(f"_shape{i}"), pieces)
            steps[4][f"_sizes{i}"] = F.when(F.col(f"_shape{i}"), measured(F.col(f"_pieces{i}")))
            steps[5][f"_ends{i}"] = F.when(F.col(f"_shape{i}"), located(F.col(f"_sizes{i}")))
            steps[6][f"_spans{i}"] = F.when(F.col(f"_shape{i}"), spans(F.col(f"_ends{i}")))
        return [step for step in steps if step]

    def word(self, words: tuple[str, ...]) -> Column:
        return F.col(f"_word{self.words.index(words)}")

    def names(self) -> list[str]:
        return [name for step in self.columns() for name in step]


@dataclass(frozen=True)
class Doc:
    """Columns of one document; ``lower`` is ``lower(text)``, computed once, and so are ``pages``, ``element_texts``
    (``joined_texts`` of the elements) and what rules share."""

    text: Column
    lower: Column
    elements: Column | None = None
    shared: Shared = Shared()
    pages: Column | None = None
    element_texts: Column | None = None

    def may_match(self, pattern: str) -> Column | None:
        """A condition that each text with a match of the pattern meets; None if nothing is known."""
        known = [self.shared.word(words) for words in _asked(pattern) if words in self.shared.words]
        known += [F.col(f"_shape{i}") for i, shape in enumerate(self.shared.shapes) if R.holds_match_of(pattern, shape)]
        return _all(known) if known else None

    def spans(self, *patterns: str) -> Column:
        """``R.match_spans``; shapes that all rules share are read, not searched."""
        found = []
        for number, pattern in enumerate(patterns):
            own = [i for i, shape in enumerate(self.shared.shapes) if R.same_matches(pattern, shape)]
            if own:
                spans = F.col(f"_spans{own[0]}")
                found.append(F.coalesce(spans if own[0] == number else _numbered(spans, number), R.no_spans()))
            else:
                may = self.may_match(pattern)
                spans = R.match_spans(self.text, pattern, first=number, likely=may is not None)
                found.append(spans if may is None else F.when(may, spans).otherwise(R.no_spans()))
        return F.flatten(F.array(*found)) if len(found) > 1 else found[0]


def _numbered(spans: Column, number: int) -> Column:
    """Spans of a shape as those of pattern ``number``; its one group at most is all of the match."""
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(number).alias("pattern"), s["start"].alias("start"), s["value"].alias("value"), s["value"].alias("best")
        ),
    )


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    if len(words) > 4:
        return R.holds_any(text, words)
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


#: Word sets asked for at most per pattern; shorter words say too little.
ASKED, SHORTEST = 3, 2


def _asked(pattern: str) -> list[tuple[str, ...]]:
    """The word sets that tell most: those with the longest shortest word; a separator of digits counts too."""
    sets = [t for t in R.held_literals(pattern) if min(map(len, t)) >= SHORTEST or t in (("/",), ("-",))]
    return sorted(dict.fromkeys(sets), key=lambda t: (-min(map(len, t)), t))[:ASKED]


def rule_patterns(rule: dict) -> list[str]:
    """The patterns that a rule looks for in a text."""
    kind = rule.get("type", "")
    listed = {
        "regex": [rule.get("regex", "")],
        "facts_pattern": [rule.get("date_regex", "")],
        "fuzzy_date": fuzzy_variants(rule.get("base_patterns", [])) if kind == "fuzzy_date" else [],
        "contextual_search": [*rule.get("target_patterns", []), *map(re.escape, rule.get("primary_keywords", []))],
        "multi_pattern": [p.get("regex", "") for p in rule.get("patterns", [])] if kind == "multi_pattern" else [],
        "multi_date": rule.get("date_patterns", []),
    }.get(kind, [])
    return [p for p in listed if p and R.is_valid(p)]


def shared_of(rules: Iterable[dict]) -> Shared:
    """What the rules share: their patterns' words, and the shapes that multi-date rules list."""
    rules = list(rules)
    shapes = dict.fromkeys(
        p for r in rules if r.get("type") == "multi_date" for p in rule_patterns(r)
        if R.is_local(p) and R.group_count(p) == 0 and not R.can_match_empty(p)
    )
    words = dict.fromkeys(t for r in rules for p in rule_patterns(r) for t in _asked(p))
    return Shared(tuple(words), tuple(shapes))


RuleType = Callable[[dict, Doc], Column]
RULE_TYPES: dict[str, RuleType] = {}


def register_rule_type(name: str) -> Callable[[RuleType], RuleType]:
    def add(fn: RuleType) -> RuleType:
        RULE_TYPES[name] = fn
        return fn

    return add


def rule_column(rule: dict, doc: Doc) -> Column:
    """Value of one rule; NULL for unknown types, misses and empty values."""
    build = RULE_TYPES.get(rule.get("type", ""))
    if build is None:
        return F.lit(None).cast("string")
    return blank_to_null(build(rule, doc))


def _none() -> Column:
    return F.lit(None).cast("string")


def _gate(doc: Doc, patterns, value: Column) -> Column:
    """Evaluate ``value`` only where one of ``patterns`` can match.

    Words and shapes that a match holds are in the text wherever the match was found, also in a window, so this holds
    for patterns that look at their surroundings too.
    """
    may = [doc.may_match(p) for p in patterns]
    if may and all(m is not None for m in may):
        return F.when(reduce(or_, may), value)
    if all(R.is_local(p) for p in patterns):
        return F.when(R.matches_any(doc.text, patterns), value)
    return value


@register_rule_type("regex")
def regex_rule(rule: dict, doc: Doc) -> Column:
    pattern = rule.get("regex", "")
    if not pattern:
        return _none()
    value, may = R.first_match(doc.text, pattern), doc.may_match(pattern)
    if not R.is_local(pattern):
        # only a look-ahead can make a group longer than the match
        groups = [R.first_match(doc.text, pattern, k) for k in range(1, R.group_count(pattern) + 1)]
        value = F.coalesce(*[F.when(F.length(g) > F.length(value), g) for g in groups], value)
    return value if may is None else F.when(may, value)


@register_rule_type("nearest_word")
def nearest_word_rule(rule: dict, doc: Doc) -> Column:
    if doc.elements is None:
        return _none()
    value, keywords = nearest_word(doc.elements, rule), rule.get("keywords", [])
    if doc.element_texts is None or not keywords:
        return value
    # elements are gone through only where one of them holds a keyword
    return F.when(reduce(or_, [F.contains(doc.element_texts, F.lit(k.lower())) for k in keywords]), value)


@register_rule_type("section_pattern")
def section_rule(rule: dict, doc: Doc) -> Column:
    starts = rule.get("start_keywords", [])
    ends = rule.get("end_keywords", [])
    if not starts:
        return _none()

    def after(keyword):
        at = position(doc.lower, keyword.lower())
        return F.when(F.contains(doc.lower, F.lit(keyword.lower())), at + len(keyword))

    start = F.coalesce(*[after(k) for k in starts])
    beyond = F.lit(2**31 - 1)

    def cut(start):
        # a keyword that is not there stands beyond all texts; what ends before it starts is empty
        stops = [
            F.when(F.contains(doc.lower, F.lit(k.lower())), position(doc.lower, k.lower(), start).bitwiseAND(beyond))
            for k in ends
        ]
        return strip(F.substring(doc.text, start + 1, F.least(beyond, *stops) - start if stops else beyond - start))

    return F.when(reduce(or_, [F.contains(doc.lower, F.lit(k.lower())) for k in starts]), let(start, cut))


@register_rule_type("facts_pattern")
def facts_rule(rule: dict, doc: Doc) -> Column:
    pattern = rule.get("date_regex", "")
    keywords = rule.get("keywords", [])
    if not pattern or not keywords:
        return _none()
    group = 1 if R.group_count(pattern) else 0
    before, after = V.FACTS_WINDOW

    def near(keyword):
        at = position(doc.lower, keyword.lower())
        cut = let(at, lambda at: window(doc.text, at - before, at + after))
        return F.when(F.contains(doc.lower, F.lit(keyword.lower())), cut)

    def found(cut):
        return F.when(R.matches(cut, pattern), R.first_match(cut, pattern, group))

    value = F.coalesce(*[let(near(k), found) for k in keywords])
    return _gate(doc, [pattern], value)


@register_rule_type("case_title")
def title_rule(rule: dict, doc: Doc) -> Column:
    before, after = V.TITLE_WINDOW

    def title(keyword):
        at = position(doc.text, keyword)
        lines = F.split(window(doc.text, at - before, at + after), "\n", -1)
        holding = F.filter(lines, lambda line: F.contains(line, F.lit(keyword)))
        cleaned = F.transform(
            holding,
            lambda line: strip(
                F.regexp_replace(strip(line), R.CASE_SENSITIVE + V.TITLE_CASE_NUMBER, "")
            ),
        )
        usable = F.filter(cleaned, lambda line: F.length(line) > V.TITLE_MIN_LENGTH)
        return F.when(at >= 0, F.get(usable, F.lit(0)))

    keywords = rule.get("keywords", list(V.TITLE_KEYWORDS))
    return F.coalesce(*[title(k) for k in keywords]) if keywords else _none()


def fuzzy_variants(base_patterns) -> list[str]:
    """Spelling variants in trial order; variants that do not compile are left out."""
    variants = []
    for base in base_patterns:
        tried = [base] + [base.replace(old, new) for old, new in V.FUZZY_SUBSTITUTIONS]
        variants += [v for v in tried if R.is_valid(v)]
    return list(dict.fromkeys(variants))


@register_rule_type("fuzzy_date")
def fuzzy_rule(rule: dict, doc: Doc) -> Column:
    variants = fuzzy_variants(rule.get("base_patterns", []))
    if not variants:
        return _none()
    before, after = V.FUZZY_WINDOW
    tries = []
    for keyword in rule.get("context_keywords", []):
        at = position(doc.lower, keyword.lower())
        near = let(at, lambda at: window(doc.text, at - before, at + after))

        def best(near):
            # words of a window stand in the text too
            usable = [(R.best_group(near, v), doc.may_match(v)) for v in variants]
            return F.coalesce(*[x if may is None else F.when(may, x) for x, may in usable])

        tries.append(F.when(F.contains(doc.lower, F.lit(keyword.lower())), let(near, best)))
    for v in variants:
        found, may = R.best_group(doc.text, v), doc.may_match(v)
        tries.append(found if may is None else F.when(may, found))
    return _gate(doc, variants, F.coalesce(*tries))


@register_rule_type("contextual_search")
def contextual_rule(rule: dict, doc: Doc) -> Column:
    primaries = rule.get("primary_keywords", [])
    secondaries = rule.get("secondary_keywords", [])
    targets = [t for t in rule.get("target_patterns", []) if R.is_valid(t)]
    radius = rule.get("search_radius", 250)
    if not primaries or not targets:
        return _none()

    def score_window(near, low):
        score = F.lit(1.0)
        for secondary in secondaries:
            score = score + F.when(
                F.contains(low, F.lit(secondary.lower())), F.lit(V.SECONDARY_KEYWORD_WEIGHT)
            ).otherwise(F.lit(0.0))
        value = F.coalesce(*[R.best_group(near, t) for t in targets])
        return F.struct(score.alias("score"), value.alias("value"))

    # earliest keyword, then earliest position; a later window wins only with
    # a strictly higher score
    nothing = F.struct(F.lit(0.0).alias("score"), _none().alias("value"))

    # a window is cut and lowered once, then asked for each word
    def windows(spans, pages):
        return F.transform(spans, lambda x: page_window(pages, x["start"] - radius, x["start"] + radius))

    def lowered(windows, _):
        return F.transform(windows, lambda near: F.struct(near.alias("near"), F.lower(near).alias("low")))

    def best(windows, _):
        return F.aggregate(
            F.transform(windows, lambda w: score_window(w["near"], w["low"])),
            nothing,
            lambda acc, c: F.when(c["value"].isNotNull() & (c["score"] > acc["score"]), c).otherwise(acc),
        )["value"]

    spans = doc.spans(*[re.escape(p) for p in primaries])
    return _gate(doc, targets, _on_spans(spans, doc, windows, lowered, best))


def _on_spans(spans: Column, doc: Doc, *steps) -> Column:
    """``steps`` over the spans, each called with a result and the pages of the text; NULL without spans.

    Pages that all rules share are read where a window is cut; others travel from step to step.
    """
    def over_shared(step):
        return lambda found: step(found, doc.pages)

    def along(step):
        return lambda s: F.struct(step(s["found"], s["pages"]).alias("found"), s["pages"].alias("pages"))

    if doc.pages is not None:
        return chain(spans, lambda found: F.when(F.size(found) > 0, found), *map(over_shared, steps))

    def with_pages(found):
        return F.when(F.size(found) > 0, F.struct(found.alias("found"), pages(doc.text).alias("pages")))

    return chain(spans, with_pages, *map(along, steps))["found"]


@register_rule_type("multi_pattern")
def scored_rule(rule: dict, doc: Doc) -> Column:
    listed = rule.get("patterns", [])
    usable = [
        (i, p.get("regex", ""), float(p.get("weight", 1.0)))
        for i, p in enumerate(listed)
        if p.get("regex") and R.is_valid(p["regex"])
    ]
    if not usable:
        return _none()
    bonus = [0.0]  # running sums, added up in the order a loop would
    for _ in V.SCORED_CONTEXT_WORDS:
        bonus.append(bonus[-1] + V.SCORED_WORD_WEIGHT)
    bonuses = F.array(*[F.lit(b) for b in bonus])
    ranks = F.array(*[F.lit(weight * (len(listed) - i)) for i, _, weight in usable])

    # a window is cut and lowered once, then asked for each word
    def in_context(spans, pages):
        def near(span):
            start, end = span["start"] - V.SCORED_CONTEXT, span["start"] + F.length(span["value"]) + V.SCORED_CONTEXT
            return F.struct(span.alias("span"), F.lower(page_window(pages, start, end)).alias("low"))

        return F.transform(spans, near)

    def candidate(found):
        span, near = found["span"], found["low"]
        words = F.lit(0)
        for word in V.SCORED_CONTEXT_WORDS:
            words = words + F.contains(near, F.lit(word)).cast("int")
        total = (
            F.get(ranks, span["pattern"])
            + F.length(span["best"]) * F.lit(V.SCORED_LENGTH_WEIGHT)
            + F.get(bonuses, words)
        )
        return F.struct(
            total.alias("score"),
            (-span["pattern"]).alias("by_pattern"),
            (-span["start"]).alias("by_start"),
            span["best"].alias("value"),
        )

    def best(found, _):
        return F.array_max(F.transform(found, candidate))["value"]

    return _on_spans(doc.spans(*[p for _, p, _ in usable]), doc, in_context, best)


@register_rule_type("multi_date")
def multi_date_rule(rule: dict, doc: Doc) -> Column:
    patterns = [p for p in rule.get("date_patterns", []) if R.is_valid(p)]
    indicators = rule.get("incident_indicators", [])
    radius = rule.get("context_radius", 50)
    if not patterns:
        return _none()

    def dated(spans):
        kept = F.filter(spans, lambda s: ~is_padded_numeric(s["value"]))
        searched = F.transform(kept, lambda s: F.struct(s.alias("span"), date_parts(s["value"]).alias("parts")))
        return F.transform(
            searched,
            lambda x, i: F.struct(
                from_parts(x["parts"]).alias("standard"), i.alias("by_pattern"),
                x["span"]["start"].alias("start"), x["span"]["value"].alias("value"),
            ),
        )

    def first_of_each(dated):
        # sorted by date and place; what has no date stays
        return F.filter(
            dated,
            lambda d, i: d["standard"].isNull()
            | (i == 0)
            | ~F.get(dated, i - 1)["standard"].eqNullSafe(d["standard"]),
        )

    words = F.expr("cast(array() as array<string>)")

    def near(d, pages):
        low = F.lower(page_window(pages, d["start"] - radius, d["start"] + F.length(d["value"]) + radius))
        return F.struct(d.alias("date"), low.alias("low"))

    def with_words(x):
        found = F.array_compact(F.array(*[F.when(F.contains(x["low"], F.lit(w.lower())), F.lit(w)) for w in indicators])) if indicators else words
        return F.struct(x["date"].alias("date"), found.alias("found"))

    def rank(x):
        d, found = x["date"], x["found"]
        shown = F.array_join(F.slice(found, 1, V.MULTI_DATE_SHOWN_INDICATORS), ", ")
        label = F.when(F.size(found) > 0, F.concat(d["value"], F.lit(" ("), shown, F.lit(")"))).otherwise(d["value"])
        return F.struct(
            (-F.size(found)).alias("by_score"), d["start"].alias("by_start"), d["by_pattern"].alias("by_pattern"),
            label.alias("label"),
        )

    def sorted_dates(spans, _):
        return F.sort_array(dated(spans))

    def in_context(dates, pages):
        return F.transform(first_of_each(dates), lambda d: near(d, pages))

    def listed(found, _):
        ranked = F.sort_array(F.transform(F.transform(found, with_words), rank))
        return F.array_join(F.transform(F.slice(ranked, 1, V.MULTI_DATE_TOP), lambda r: r["label"]), V.MULTI_DATE_SEPARATOR)

    return _on_spans(doc.spans(*patterns), doc, sorted_dates, in_context, listed)


def emails(text: Column) -> Column:
    """Unique e-mail addresses in code-point order, joined with ``', '``."""
    # what stands before the @ holds none, so giving characters back finds nothing more
    pattern = "(?U)" + V.EMAIL.replace("]+@", "]++@")
    usable = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    if R.least_width(V.EMAIL) <= V.EMAIL_MIN_LENGTH:
        usable = F.filter(usable, lambda e: F.length(e) > V.EMAIL_MIN_LENGTH)
    return F.when(F.contains(text, F.lit("@")), filled(F.array_join(usable, ", ")))


@register_rule_type("email")
def email_rule(rule: dict, doc: Doc) -> Column:
    return emails(doc.text)
