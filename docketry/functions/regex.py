"""Regular expressions: rule dialect to Java, match positions, best group.

Rule packs are written in Python's dialect.  Patterns are checked once on the
driver and become literals in the plan, so each task compiles them once.
"""

from __future__ import annotations

import re
from re import _parser as re_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, chain, running_totals

IGNORE_CASE = "(?idU)"  # ignore case, '.' stops at \n only, Unicode classes
CASE_SENSITIVE = "(?dU)"

_QUANTIFIER = re.compile(r"\{\d*(?:,\d*)?\}")
_RENAMED_ESCAPES = {"Z": "z"}
_WORD_CHOICE = re.compile(r"(\((?:\?:)?)([A-Za-z]+(?:\|[A-Za-z]+){3,})\)")
# letters outside ASCII which equal an ASCII letter when case is ignored
_OTHER_CASES = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def is_valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def has_java_spelling(pattern: str) -> bool:
    """False for what Java lacks: groups that depend on other groups, characters by name."""
    by_name = re.search(r"(?<!\\)(?:\\\\)*\\N\{", pattern)
    return not by_name and "GROUPREF_EXISTS" not in repr(re_parser.parse(pattern))


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def least_width(pattern: str) -> int:
    """Characters of the shortest match."""
    return re_parser.parse(pattern).getwidth()[0]


def can_match_empty(pattern: str) -> bool:
    return least_width(pattern) == 0


def is_local(pattern: str) -> bool:
    """True if a match inside a cut-out of a text implies a match in the text.

    Holds unless the pattern looks at its surroundings (anchors, word
    boundaries, look-arounds) or refuses to backtrack.
    """
    return not re.search(r"\\[bBAZzG]|\^|\$|\(\?[=!>]|\(\?<[=!]|[*+?}]\+", pattern)


def held_literals(pattern: str) -> list[tuple[str, ...]]:
    """What each match holds, whatever its case: at least one of each tuple's lower-case strings."""
    return _held(re_parser.parse(pattern))


def _held(tree) -> list[tuple[str, ...]]:
    found, run = [], ""
    for op, av in [*tree, (None, None)]:
        kind = str(op)
        if kind == "LITERAL" and av < 128:
            run += chr(av).lower()
            continue
        if run:
            found.append((run,))
            run = ""
        if kind == "SUBPATTERN":
            found += _held(av[3])
        elif kind == "ATOMIC_GROUP":
            found += _held(av)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and av[0] > 0:
            found += _held(av[2])
        elif kind == "BRANCH":
            each = [_held(branch) for branch in av[1]]
            if all(each):
                best = [max(held, key=lambda t: min(map(len, t))) for held in each]
                found.append(tuple(dict.fromkeys(x for t in best for x in t)))
    return found


def _flat(tree) -> list:
    """Parsed steps without the groups around them."""
    out = []
    for op, av in tree:
        kind = str(op)
        if kind == "SUBPATTERN":
            out += _flat(av[3])
        elif kind == "BRANCH":
            out.append((kind, tuple(repr(_flat(b)) for b in av[1])))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            out.append((kind, av[0], repr(av[1]), repr(_flat(av[2]))))
        else:
            out.append((kind, repr(av)))
    return out


def holds_match_of(pattern: str, shape: str) -> bool:
    """True if each match of ``pattern`` holds a match of ``shape`` (a local one) as a run of its own steps."""
    steps, wanted = _flat(re_parser.parse(pattern)), _flat(re_parser.parse(shape))
    return any(steps[i : i + len(wanted)] == wanted for i in range(len(steps) - len(wanted) + 1))


def same_matches(pattern: str, shape: str) -> bool:
    """True if both match the same places and the best group of ``pattern`` is all of each match."""
    tree, groups = re_parser.parse(pattern), group_count(pattern)
    around_all = groups == 1 and len(tree) == 1 and str(tree[0][0]) == "SUBPATTERN" and tree[0][1][0] == 1
    return (groups == 0 or around_all) and _flat(tree) == _flat(re_parser.parse(shape))


def _guarded_choice(opening: str, words: str) -> str:
    """A group of words behind a look at its first letters.

    Trying a dozen month names at every character is what scans cost most; one
    look at up to three character classes skips nearly all of it.
    """
    listed = words.split("|")
    depth = min(3, min(len(w) for w in listed))
    classes = ""
    for i in range(depth):
        letters = sorted({w[i].lower() for w in listed})
        classes += "[" + "".join(x + x.upper() + _OTHER_CASES.get(x, "") for x in letters) + "]"
    return f"{opening}(?=(?-iu:{classes}))(?:{words}))"


def holds_any(text: Column, words) -> Column:
    """True where one of the lower-case words stands in a lower-case text."""
    listed = "|".join(map(re.escape, words))
    if len(words) > 3 and all(w.isalpha() and w.isascii() for w in words):
        listed = _guarded_choice("(?:", listed)
    return F.rlike(text, F.lit(listed))


def to_java(pattern: str, flags: str = IGNORE_CASE) -> str:
    """Spell a Python pattern so that Java reads it the same way."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append("\\" + _RENAMED_ESCAPES.get(nxt, nxt))
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c in "[&":
                c = "\\" + c
        elif c == "[":
            in_class = True
        elif c == "(" and _WORD_CHOICE.match(pattern, i):
            choice = _WORD_CHOICE.match(pattern, i)
            out.append(_guarded_choice(*choice.groups()))
            i = choice.end()
            continue
        elif pattern.startswith("(?P<", i):
            # groups are taken by number, and Java allows fewer names
            out.append("(")
            i = pattern.index(">", i) + 1
            continue
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            number = re.compile(pattern).groupindex[pattern[i + 4 : end]]
            out.append(f"(?:\\{number})")
            i = end + 1
            continue
        elif c == "{":
            quantifier = _QUANTIFIER.match(pattern, i)
            if quantifier and quantifier.group() not in ("{}", "{,}"):
                text = quantifier.group()
                out.append("{0" + text[1:] if text[1] == "," else text)
                i = quantifier.end()
                continue
            c = "\\{"
        elif c == "}":
            c = "\\}"
        out.append(c)
        i += 1
    return flags + "".join(out)


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(to_java(pattern)))


def matches_any(text: Column, patterns) -> Column:
    return F.rlike(text, F.lit("|".join("(?:" + to_java(p) + ")" for p in patterns)))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(text, to_java(pattern), group)


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(to_java(pattern)), F.lit(0))


#: Stands around matches in a marked text; texts that hold it are scanned twice.
MARK = "\uffff"


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<pattern:int,start:int,value:string,best:string>>)")


def match_spans(text: Column, *patterns: str, first: int = 0, likely: bool = False) -> Column:
    """All matches with their place: ``array<struct<pattern, start, value, best>>``.

    ``pattern`` numbers the patterns (from ``first``), ``start`` counts from 0, ``best`` is the best group. Exact for patterns which
    cannot match the empty string. Matches and the gaps between them alternate; places are running totals of their
    lengths, so the time grows with the text and with m log m for m matches. ``likely`` leaves out the search that
    tells texts without a match apart, where most texts that come here hold one.
    """
    found = [_spans(text, p, i, likely) for i, p in enumerate(patterns, first)]
    return F.flatten(F.array(*found)) if len(found) > 1 else found[0]


def _alternating(text: Column, pattern: str) -> Column:
    """Gap, match, gap, ..., gap: by one scan that sets marks, or by two where the text holds the mark itself."""
    marked = F.split(F.regexp_replace(text, to_java(pattern), MARK + "$0" + MARK), MARK, -1)
    gaps = F.split(text, to_java(pattern), -1)
    zipped = F.zip_with(gaps, all_matches(text, pattern), lambda gap, match: F.array(gap, match))
    return F.when(F.contains(text, F.lit(MARK)), F.array_compact(F.flatten(zipped))).otherwise(marked)


def span_steps(text: Column, pattern: str, number: int):
    """A first value and the steps that make spans of it; side by side, as a chain or as projections."""
    groups = range(1, group_count(pattern) + 1)
    by_group = None
    if groups and not is_local(pattern):
        # what a group holds may depend on the text around the match
        by_group = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(to_java(pattern)), F.lit(k)).alias(f"group{k}") for k in groups])

    def measured(pieces):
        # places of one or two matches need no running totals
        sizes = F.when(F.size(pieces) > 5, F.transform(pieces, F.length))
        return F.struct(pieces.alias("pieces"), sizes.alias("sizes"), (F.lit(0) if by_group is None else by_group).alias("groups"))

    def located(s):
        ends = F.when(s["sizes"].isNotNull(), running_totals(s["sizes"]))
        return F.struct(s["pieces"].alias("pieces"), s["groups"].alias("groups"), ends.alias("ends"))

    def spans(s):
        def piece(i):
            return F.get(s["pieces"], F.lit(i))

        def span(i, start):
            value = F.get(s["pieces"], 2 * i + 1)
            if not groups:
                best = value
            elif by_group is None:
                best = best_group(value, pattern)
            else:
                best = _longest(value, [F.get(s["groups"], i)[f"group{k}"] for k in groups])
            return F.struct(F.lit(number).alias("pattern"), start.alias("start"), value.alias("value"), best.alias("best"))

        first = span(F.lit(0), F.length(piece(0)))
        second = span(F.lit(1), F.length(piece(0)) + F.length(piece(1)) + F.length(piece(2)))
        last = F.floor(F.size(s["pieces"]) / 2).cast("int") - 1
        every = F.transform(F.sequence(F.lit(0), last), lambda i: span(i, F.get(s["ends"], 2 * i)))
        return (
            F.when(F.size(s["pieces"]) == 3, F.array(first))
            .when(F.size(s["pieces"]) == 5, F.array(first, second))
            .when(s["ends"].isNotNull(), every)
            .otherwise(no_spans())
        )

    return _alternating(text, pattern), (measured, located, spans)


def _spans(text: Column, pattern: str, number: int, likely: bool) -> Column:
    pieces, steps = span_steps(text, pattern, number)
    if likely:
        return F.when(text.isNotNull(), chain(pieces, *steps))
    # most texts hold no match: one plain search, no arrays
    return F.when(matches(text, pattern), chain(pieces, *steps)).when(text.isNotNull(), no_spans())


def _longest(whole: Column, groups: list[Column]) -> Column:
    if not groups:
        return whole
    if len(groups) == 1:
        return F.coalesce(blank_to_null(groups[0]), whole)
    longest = F.aggregate(
        F.array(*groups),
        F.lit(""),
        lambda best, g: F.when(F.length(g) > F.length(best), g).otherwise(best),
    )
    return F.coalesce(blank_to_null(longest), whole)


def has_sure_group(pattern: str) -> bool:
    """True if the pattern has one group, which is never empty in a match."""
    def sure(tree) -> bool:
        for op, av in tree:
            kind = str(op)
            if kind == "SUBPATTERN" and (sure(av[3]) or (av[0] == 1 and av[3].getwidth()[0] > 0)):
                return True
            if kind == "MAX_REPEAT" and av[0] > 0 and sure(av[2]):
                return True
        return False

    return group_count(pattern) == 1 and sure(re_parser.parse(pattern))


def _first_of_all(text: Column, pattern: str, group: int) -> Column:
    """A group that no match leaves empty: NULL without a match, and the text is searched once (twice by ``nullif``)."""
    return F.get(F.regexp_extract_all(text, F.lit(to_java(pattern)), F.lit(group)), F.lit(0))


def best_group(text: Column, pattern: str) -> Column:
    """Longest non-empty group of the first match (first on ties), else all of it."""
    if has_sure_group(pattern):
        return _first_of_all(text, pattern, 1)
    if group_count(pattern) == 0 and not can_match_empty(pattern):
        return _first_of_all(text, pattern, 0)
    groups = [first_match(text, pattern, k) for k in range(1, group_count(pattern) + 1)]
    return _longest(blank_to_null(first_match(text, pattern)), groups)
