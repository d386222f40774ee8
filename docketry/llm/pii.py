"""Personal data with DataFrame functions alone: base patterns with checks, and spans that boosted trees add.

Generators propose spans of the same kinds with far looser formats, overlapping ones among them. Gradient-boosted trees
(Spark's own, in the JVM) score them by format and context. They learn from the base patterns: examples are candidates
equal to a base span, and base spans respelled in loose ways (at and dot, other separators, no plus); counterexamples
are candidates that cover a base match which fails its check, base spans broken so that they fail it, and bare numbers
for phones. Other loose candidates have no label, so they are neither learnt from nor calibrated on. Each kind has its
own threshold: the least score at which its examples hold the wanted precision. Base spans always stay.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

KINDS = ("email", "ip", "card", "phone")
#: Rounds and depth of the trees, precision of the thresholds.
ROUNDS, DEPTH, PRECISION = 8, 3, 0.99
SPANS = "array<struct<start:int,kind:int,end:int>>"

#: The base patterns as Java reads them in time linear in the text: repeats give nothing back (what follows them never
#: needs it), and a match may begin inside a run of its own characters only where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Loose formats.
LOOSE = {
    "email": (
        r"[\p{L}0-9._%+-]{1,64}+(?:\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}0-9-]{1,63}+(?:(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20)[\p{L}0-9-]{1,63}+){1,8}+"
        r"|\x20at\x20[\p{L}0-9-]{1,63}+(?:\x20dot\x20[\p{L}0-9-]{1,63}+){1,8}+)"
    ),
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:[.,:][0-9]{1,4}+){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,5}+(?![0-9])",
}
LOOSE_GATE = {"email": r"@|\(at\)|\[at\]|\x20dot\x20", "ip": r"[0-9][.,:][0-9]", "card": r"[0-9](?:[\x20.-]?[0-9]){12}", "phone": r"[0-9]{2}"}
#: Words that speak for each kind, looked for in the characters before a candidate.
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay", "phone": "tel|phone|call|fax|mobile"}
BEFORE = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _small_parts(ip: Column, separators: str = r"\.") -> Column:
    return F.forall(F.split(ip, separators), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(kind: str, match: Column) -> Column:
    """The checks of the base patterns."""
    n = F.length(_digits(match))
    return {
        "email": F.lit(True), "ip": _small_parts(match),
        "card": F.when(n.between(14, 19), luhn(_digits(match))).otherwise(F.lit(False)), "phone": n.between(10, 15),
    }[kind]


def refuses(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern fails a check for what it is; numbers too short or long for a card may be others."""
    return ~valid(kind, match) & (F.length(_digits(match)).between(14, 19) if kind == "card" else F.lit(True))


def found(text: Column, kind: int, pattern: str, gate: str) -> Column:
    """array<struct<start, kind, end, match>> of all matches; places count code points.

    The matches and what stands between them add up to the text, so places are running sums of lengths.
    """
    def place(between: Column) -> Column:
        def walk(matches: Column) -> Column:
            pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("match")))
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>").alias("spans"))

            def step(a: Column, p: Column) -> Column:
                begin = a["at"] + p["gap"]
                end = begin + F.length(p["match"])
                span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["match"].alias("match"))
                return F.struct(end.alias("at"), F.array_append(a["spans"], span).alias("spans"))

            return F.aggregate(pairs, start, step, lambda a: a["spans"])

        return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    return F.when(text.rlike(gate), _let(F.split(text, pattern, -1), place)).otherwise(none)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_spans(text: Column) -> Column:
    """Valid matches of the base patterns, ordered by start and then by kind."""
    def of_kind(k: int, kind: str) -> Column:
        good = F.filter(found(text, k, BASE[kind], GATE[kind]), lambda s: valid(kind, s["match"]))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    every = [of_kind(k, kind) for k, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*every)).cast(SPANS)


FEATURES = (
    "length", "digits", "separators", "letters", "plus", "at", "dots", "luhn", "small_parts", "glued_before", "glued_after", "context",
    "sound", "bare",
    *(f"is_{k}" for k in KINDS),
)


def _features(text: Column, s: Column) -> list[Column]:
    """Format and context of a candidate."""
    m, digits = s["match"], _digits(s["match"])
    before = F.lower(F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))))
    context = reduce(lambda a, b: a | b, [(s["kind"] == k) & before.rlike(CONTEXT[kind]) for k, kind in enumerate(KINDS)])
    is_phone = s["kind"] == KINDS.index("phone")
    called = F.length(_digits(F.regexp_replace(m, "^00", ""))).between(10, 15)
    checks = {"email": ~m.rlike(r"[^\x20]\.\x20"), "ip": _small_parts(m, "[.,:]"), "card": F.length(digits).between(13, 19) & luhn(digits), "phone": called}
    sound = reduce(lambda a, b: a | b, [(s["kind"] == k) & checks[kind] for k, kind in enumerate(KINDS)])
    flags = [
        F.length(m), F.length(digits), F.length(F.regexp_replace(m, r"[^\x20().,:-]", "")), F.length(F.regexp_replace(m, r"[^\p{L}]", "")),
        F.startswith(m, F.lit("+")), F.contains(m, F.lit("@")), F.length(F.regexp_replace(m, r"[^.]", "")),
        F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False)), _small_parts(m, "[.,:]"),
        F.substring(before, -1, 1).rlike(r"[\p{L}0-9]"), F.substring(text, s["end"] + 1, F.lit(1)).rlike(r"[\p{L}0-9]"), context,
        sound, is_phone & m.rlike("^(?!00)[0-9]+$"),
        *(s["kind"] == k for k in range(len(KINDS))),
    ]
    return [f.cast("double") for f in flags]


def _scored(text: Column, s: Column) -> Column:
    return F.struct(*(f.alias(n) for f, n in zip(_features(text, s), FEATURES, strict=True))).alias("features")


def _refused(text: Column, k: int, kind: str) -> Column:
    return F.filter(found(text, k, BASE[kind], GATE[kind]), lambda m: refuses(kind, m["match"]))


def candidates(texts: DataFrame) -> DataFrame:
    """key, start, kind, end, features of every loose match in texts (key, text, base); overlaps: a base span; label: 1
    if it is a base span, 0 if it covers a base match of its kind that fails its check or is a bare number where a phone might be, else
    null; around (of base spans): what stands before, the span, what stands after."""
    every = F.concat(*(found(F.col("text"), k, LOOSE[kind], LOOSE_GATE[kind]) for k, kind in enumerate(KINDS)))
    failing = F.concat(*(_refused(F.col("text"), k, kind) for k, kind in enumerate(KINDS)))
    s = F.col("s")
    of_base = F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] == s["start"]) & (b["end"] == s["end"]))
    inside = F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    refused = F.exists("failing", lambda b: (b["kind"] == s["kind"]) & (s["start"] <= b["start"]) & (b["end"] <= s["end"]))
    bare = (s["kind"] == KINDS.index("phone")) & s["match"].rlike("^(?!00)[0-9]+$") & (F.col("features.context") == 0)
    around = F.struct(
        F.substring("text", F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))).alias("before"), s["match"].alias("match"),
        F.substring("text", s["end"] + 1, F.lit(BEFORE)).alias("after"),
    )
    rows = texts.withColumn("failing", failing).withColumn("s", F.explode(every)).withColumn("features", _scored(F.col("text"), s))
    return rows.select(
        "key", "s.start", "s.kind", "s.end", "features", F.when(of_base, 1.0).when(~inside & (refused | bare), 0.0).alias("label"), inside.alias("overlaps"),
        F.when(of_base, around).alias("around"),
    )


def _swapped(x: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(x, pattern, new)


def respelled(kind: str, m: Column) -> list[tuple[str, Column, int]]:
    """What is put before, spelling and label of loose variants of a base span; null where there is none."""
    digits = _digits(m)
    if kind == "email":
        name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        joined = lambda at, dot: F.concat(name, F.lit(at), _swapped(host, r"\.", dot))
        good = [joined(*x) for x in ((" (at) ", " (dot) "), (" (at) ", " dot "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."))]
        # an address that a sentence ends is none
        return [("", g, 1) for g in good] + [("", joined(*x), 0) for x in ((" @ ", ". "), ("@", ". "), (" (at) ", ". "))]
    if kind == "ip":
        bad = F.concat(F.lit("99"), m)
        return [("", _swapped(m, r"\.", x), 1) for x in ",:"] + [("", _swapped(F.when(bad.rlike(r"^[0-9]{3,4}\."), bad), r"\.", x), 0) for x in ".,:"]
    if kind == "card":
        sums = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: luhn(F.concat(F.left(digits, F.lit(12)), c.cast("string"))))
        short = F.concat(F.left(digits, F.lit(12)), F.get(sums, F.lit(0)).cast("string"))
        wrong = lambda x: F.concat(F.left(x, F.length(x) - 1), ((F.right(x, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        spelt = lambda x, by: _swapped(x, "([0-9]{4})(?=[0-9])", f"$1{by}")
        return [("", spelt(x, by), label) for d in (digits, short) for x, label in ((d, 1), (wrong(d), 0)) for by in ("", ".", "-", " ")]
    groups = F.trim(_swapped(m, "[^0-9]+", " "))
    fewer, more = _swapped(groups, " [0-9]+$", ""), F.concat(groups, F.lit(" "), groups)
    home = _swapped(m, r"^\+[0-9]{1,3}[\x20-]*(?=\()", "")
    home = F.when(home.startswith("(") & F.length(_digits(home)).between(10, 15), home)
    plain = [_swapped(groups, " ", x) for x in ".- "]
    good = [*plain, F.concat(F.lit("00"), groups), F.concat(F.lit("00"), digits), home, F.substring(m, 2, 100)]
    bad = [_swapped(x, " ", by) for x in (fewer, more) for by in ".- "] + [F.concat(F.lit("00"), fewer)]
    return [("", g, 1) for g in good] + [("tel ", digits, 1)] + [("", b, 0) for b in bad] + [("no. ", digits, 0), ("no. ", _digits(fewer), 0)]


def examples(rows: DataFrame) -> DataFrame:
    """key, start, kind, features, label of loose variants of all base spans, in their surroundings."""
    out = []
    for k, kind in enumerate(KINDS):
        of_kind = rows.where((F.col("label") == 1) & (F.col("kind") == k))
        variants = F.array(*(
            F.struct(F.concat(F.lit("") if put else F.col("around.before"), F.lit(put)).alias("before"), x.alias("match"), F.lit(float(label)).alias("label"))
            for put, x, label in respelled(kind, F.col("around.match"))
        ))
        spelt = of_kind.select("key", "start", "around.after", F.explode(variants).alias("v")).where("v.match is not null")
        text, start = F.concat("v.before", "v.match", "after"), F.length("v.before")
        s = F.filter(found(F.col("text"), k, LOOSE[kind], LOOSE_GATE[kind]), lambda s: (s["start"] == start) & (s["match"] == F.col("v.match")))
        told = spelt.withColumn("text", text).withColumn("s", F.explode(s))
        out.append(told.select("key", "start", F.lit(k).alias("kind"), _scored(F.col("text"), F.col("s")), F.col("v.label").alias("label")))
    return reduce(DataFrame.unionByName, out)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows.select("*", "features.*"))


def fit(rows: DataFrame) -> tuple[GBTClassificationModel, list[float]] | None:
    """Trees and the threshold of each kind from all candidates with a label; None where no example or no counterexample is known."""
    known = rows.where("label is not null").select("key", "start", "kind", "features", "label")
    learn = stored(known.withColumn("loose", F.col("label") == 0).unionByName(examples(rows).withColumn("loose", F.lit(True))))
    if learn.select("label").distinct().count() < 2:
        return None
    # every third place calibrates the thresholds, with all variants of its span, and is not learnt from
    part = F.pmod(F.xxhash64("key", "start"), F.lit(3)) == 0
    train = learn.where(~part)
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=5).fit(_assembled(train))
    bins = (
        model.transform(_assembled(learn.where(part & F.col("loose")))).groupBy("kind", F.floor(F.get(vector_to_array("probability"), F.lit(1)) * 1000).alias("bin"))
        .agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    )
    thresholds = []
    for k in range(len(KINDS)):
        good = n = 0.0
        thresholds.append(math.inf)
        for r in sorted((r for r in bins if r["kind"] == k), key=lambda r: -r["bin"]):
            good, n = good + r["good"], n + r["n"]
            if r["good"] and good >= PRECISION * n:
                thresholds[k] = r["bin"] / 1000
    return model, thresholds


def find(docs: DataFrame) -> DataFrame:
    """docs with base and spans: arrays of (start, kind, end), ordered by start and then kind (its number in KINDS).

    Places count code points, the end is exclusive. base holds valid matches of the base patterns, leftmost and without
    overlap per kind; matches that fail their check are dropped and not tried again. spans holds these and the loose
    candidates that the trees select, of those that no base span overlaps. Null and empty texts have none. Each row is judged by
    its own text, so rows that repeat get the same spans; columns named base or spans are replaced.
    """
    key, more_spans = unused("key", docs.columns), unused("more", docs.columns)
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    d = docs.select(*kept).withColumn("base", F.coalesce(base_spans(F.col("text")), F.array().cast(SPANS)))
    loose = F.col("text").rlike("|".join(LOOSE_GATE.values()))
    texts = d.where(loose).select(F.xxhash64("text").alias("key"), "text", "base").dropDuplicates(["key"])
    rows = stored(candidates(texts))
    fitted = fit(rows)
    if fitted is None:
        return d.withColumn("spans", F.col("base"))
    model, thresholds = fitted
    threshold = F.get(F.array(*map(F.lit, thresholds)), F.col("kind"))
    more = (
        model.transform(_assembled(rows.where(~F.col("overlaps")))).where(F.get(vector_to_array("probability"), F.lit(1)) >= threshold)
        .groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("start", "kind", "end")).alias(more_spans))
    )
    joined = d.withColumn(key, F.xxhash64("text")).join(more, key, "left")
    return joined.select(*kept, "base", F.array_sort(F.array_union("base", F.coalesce(more_spans, F.array().cast(SPANS)))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first covers what they share, and
    what the later ones have beyond it goes without a mark of its own."""
    mark = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        more = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(mark, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], more).otherwise(F.lit(""))).alias("out"))

    def rest(a: Column) -> Column:
        return F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
