"""Column building blocks against plain Python on awkward strings."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from docketry import fixed_values as V
from docketry.functions import regex as R
from docketry.functions import text as N
from docketry.operators import contact as K
from docketry.operators import layout as L
from docketry.operators.rules import Doc, fuzzy_variants, rule_column
from docketry.registry.queries import PACK

AWKWARD = [
    "", " ", "\n", "no date", "On May 1, 2020", "May 1, 2020May 2, 2021", "é May 3, 2020 ü",
    "😀 on or about June 17th, 2025 😀 on or about june 18, 2025", "3/12/2020 13/12/2020 3/12/20201",
    "12/3/20203/4/2021", "auguſt 5, 2020", "x\x00May 4, 2020\x00 5-6-2020", "MAY 5,\n\n2020",
    "on ١/٢/٢٠٢٠ x", "a@b.co, z@y.org a@b.co é@q.com c@d.e1.fr.",
    "incident incident ACCIDENT occurred On May 6, 2020 facts on 1/2/2020",
]


def column(spark, make, texts=AWKWARD):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["v"] for r in df.select("id", make(F.col("text")).alias("v")).orderBy("id").collect()]


PATTERNS = [p for p in PACK.rules["multiple_dates_extractor"]["date_patterns"]] + [
    p["regex"] for p in PACK.rules["advanced_incident_date"]["patterns"]
] + [r"\bMay\b\s+(\d)", r"(?<=o)n\s", r"(on|about)\s+(May|June|July|August)"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_match_positions(spark, pattern):
    got = column(spark, lambda t: R.match_spans(t, pattern))
    for text, spans in zip(AWKWARD, got):
        want = []
        for m in re.finditer(pattern, text, re.IGNORECASE):
            groups = [g for g in m.groups() if g]
            want.append((m.start(), m.group(), max(groups, key=len) if groups else m.group()))
        assert [(s["start"], s["value"], s["best"]) for s in spans] == want, text


def test_java_spelling_of_python_patterns(spark):
    for pattern in fuzzy_variants(PACK.rules["fuzzy_incident_date"]["base_patterns"]) + [
        r"a{1[,.]?2}", r"(?P<m>May)\s", r"[[&]x", r"x{,2}y", r"(?P<my_date>May)\s", r"(?P<q>['\"])x(?P=q)0?",
    ]:
        texts = AWKWARD + ["a{12}", "a{1,2}", "[x &x", "xxy y", "'x\" 'x'0"]
        got = column(spark, lambda t: R.first_match(t, pattern), texts)
        want = [m.group() if (m := re.search(pattern, t, re.IGNORECASE)) else "" for t in texts]
        assert got == want, pattern


def normal(s):
    s = " ".join(s.lower().split())
    return "".join(c for c in s if c not in V.PUNCTUATION)


BLANKS = AWKWARD + ["\x1c a \x85b c ", " - a - \n\t (B)\r\n  ; c", "\n\n x \n"]


def test_normalize_text_and_lines(spark):
    assert column(spark, N.normalize_text, BLANKS) == [normal(s) for s in BLANKS]
    assert column(spark, N.normalized_lines, BLANKS) == [
        [normal(x) for x in s.split("\n")] for s in BLANKS]
    assert column(spark, N.strip, BLANKS) == [s.strip() for s in BLANKS]


def test_lines_with_offsets(spark):
    for text, rows in zip(BLANKS, column(spark, N.lines_with_offsets, BLANKS)):
        assert [r["line"] for r in rows] == text.split("\n")
        assert all(text[r["offset"]:].startswith(r["line"]) for r in rows)


def noisy_lines(n=400):
    rng = random.Random(7)
    lines = []
    for _ in range(n):
        s = list(rng.choice(V.BATCH_TRIGGERS))
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(s))
            kind = rng.random()
            if kind < 0.4:
                s[at] = rng.choice("abcdefgh .")
            elif kind < 0.7 and len(s) > 3:
                del s[at]
            else:
                s.insert(at, rng.choice("xyz e"))
        lines.append("".join(s).replace("\n", " "))
    return lines


def similar(line, phrases):
    return any(
        difflib.SequenceMatcher(None, normal(p), normal(line)).ratio() > 0.8 for p in phrases)


def test_pruning_never_loses_a_similar_line(spark):
    lines = noisy_lines()
    for phrase in V.BATCH_TRIGGERS:
        kept = column(spark, lambda t: F.expr(K.may_be_similar("text", normal(phrase))),
                      [normal(x) for x in lines])
        for line, keep in zip(lines, kept):
            assert keep or not similar(line, [phrase])
    assert any(similar(x, V.BATCH_TRIGGERS) for x in lines)


def brute_contact(text, phrases, ignore_case):
    at = 0
    for line in text.split("\n"):
        hay = line.lower() if ignore_case else line
        exact = [p.lower() if ignore_case else p for p in phrases]
        hit = next((p for p in exact if p in hay), None)
        index = at + hay.find(hit) if hit else (at if similar(line, phrases) else None)
        if index is not None:
            kept = []
            for x in (y.strip() for y in text[index:index + 500].split("\n")):
                low = x.lower()
                if not x or any(t in low for t in V.CONTACT_REMOVE_TERMS):
                    continue
                if any(t in low for t in V.CONTACT_CUTOFF_TERMS):
                    break
                kept.append(x)
            return "\n".join(kept) or None
        at += len(line) + 1
    return None


@pytest.mark.parametrize("ignore_case", [True, False])
def test_contact_against_brute_force(spark, ignore_case):
    phrases = V.BATCH_TRIGGERS if ignore_case else V.STRICT_TRIGGERS
    rng = random.Random(3)
    lines = noisy_lines(120)
    fill = ["Law Office", "  a@b.org ", "", "Patient history", "İstanbul office", "Suite 5"]
    texts = ["\n".join(rng.choice(lines if rng.random() < 0.15 else fill) for _ in range(12))
             for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = K.add_contact(df, "text", "c", phrases=phrases, ignore_case=ignore_case).orderBy("id")
    got = [r["c"] for r in rows.collect()]
    assert got == [brute_contact(t, phrases, ignore_case) for t in texts]


def brute_nearest(elements, rule):
    for word in rule["keywords"]:
        for i, e in enumerate(elements):
            if word.lower() not in e[1].lower():
                continue
            near = [o[1] for o in elements[i + 1:i + 20] if o[0] == e[0] and abs(o[4] - e[4]) < 10
                    and o[2] - e[3] < rule.get("max_distance", 150)][: rule.get("extract_words", 1)]
            if near:
                value = " ".join(near)
                for d in rule.get("extract_until", []):
                    if d in value:
                        value = value[: value.find(d)]
                        break
                return value.strip() or None
    return None


def test_nearest_word_shapes_agree(spark):
    rng = random.Random(5)
    rules = {
        "a": {"type": "nearest_word", "keywords": ["Judge:", "Type:"], "max_distance": 90, "extract_words": 3},
        "b": {"type": "nearest_word", "keywords": ["type:"], "extract_until": [";", ","]},
    }
    docs = []
    for d in range(60):
        page, rows = 0, []
        for _ in range(rng.randint(1, 90)):
            page += rng.random() < 0.05
            x0 = float(rng.choice([50, 120, 180, 300]))
            word = rng.choice(["Judge:", "Case TYPE:", "Smith", "x, y; z", ";", "v w"])
            rows.append((page, word, x0, x0 + 40.0, float(rng.choice([700, 705, 715]))))
        docs.append(rows)
    flat = [(d, p, i, t, x0, x1, y) for d, rows in enumerate(docs)
            for i, (p, t, x0, x1, y) in enumerate(rows)]
    df = spark.createDataFrame(
        flat, "doc int, page int, elem_idx int, text string, x0 double, x1 double, y0 double")
    joined = {(r["doc"], r["field"]): r["value"]
              for r in L.nearest_word_join(df, rules, "doc").collect()}
    arrays = df.groupBy("doc").agg(F.array_sort(F.collect_list(
        F.struct("elem_idx", "page", "text", "x0", "x1", "y0"))).alias("elements"))
    doc = Doc(F.lit(""), F.lit(""), F.col("elements"))
    wide = arrays.select("doc", *[rule_column(r, doc).alias(n) for n, r in rules.items()]).collect()
    for row in wide:
        for name, rule in rules.items():
            want = brute_nearest(docs[row["doc"]], rule)
            assert row[name] == want
            assert joined.get((row["doc"], name)) == want
