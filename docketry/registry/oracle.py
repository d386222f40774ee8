"""DuckDB SQL giving the same rows as each registered query.

Written relationally (one row per match, window functions, joins), unlike the
column expressions it checks.
"""

from __future__ import annotations

from .. import fixed_values as V
from ..fixtures import (
    BATCH_REQUESTS_CTE,
    CASE_DOCUMENTS_CTE,
    DOCUMENT_REQUESTS_CTE,
    FILINGS_CTE,
    TROUBLED_CTE,
)
from ..functions.regex import group_count
from ..operators.rules import fuzzy_variants
from ..sources.packs import shipped_pack

PACK = shipped_pack()
NULL = "CAST(NULL AS VARCHAR)"

#: The fields of the shipped pack that hold dates of an incident; written out, so that the SQL checks the operator.
DATE_FIELDS = (
    "multiple_dates_extractor", "advanced_incident_date", "contextual_incident_search", "fuzzy_incident_date", "facts_date_2",
    "incident_date_simple", "accident_date_pattern", "date_of_incident", "at_time_pattern", "subject_incident_date", "loss_date",
    "facts_date_3", "facts_date", "numeric_date",
)


#: Fields of the shipped pack in extraction order with their rule types; written out for the same reason.
PACK_FIELDS = (
    ("case_number", "nearest_word"), ("description", "case_title"), ("case_type", "nearest_word"), ("judge_name", "nearest_word"),
    ("filed_date", "nearest_word"), ("plaintiff", "section_pattern"), ("defendant", "section_pattern"),
    ("multiple_dates_extractor", "multi_date"), ("advanced_incident_date", "multi_pattern"),
    ("contextual_incident_search", "contextual_search"), ("fuzzy_incident_date", "fuzzy_date"), ("facts_date_2", "regex"),
    ("incident_date_simple", "regex"), ("accident_date_pattern", "regex"), ("date_of_incident", "regex"), ("at_time_pattern", "regex"),
    ("subject_incident_date", "regex"), ("loss_date", "regex"), ("facts_date_3", "regex"), ("facts_date", "facts_pattern"),
    ("numeric_date", "regex"), ("complaint_facts", "section_pattern"),
)


def q(text: str) -> str:
    """SQL literal; control characters as chr()."""
    parts = text.split("\n")
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) + ")"


def rx(pattern: str) -> str:
    import re

    literal_braces = re.sub(r"\{(?!\d+(?:,\d*)?\})([^}]*)\}", r"\\{\1\\}", pattern)
    return q("(?i)" + literal_braces)


BLANKS = " || ".join(f"chr({ord(c)})" for c in V.WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def window(x: str, start: str, end: str) -> str:
    """x[start:end] for 0-based numbers."""
    return f"substr({x}, CAST(greatest({start}, 0) + 1 AS BIGINT), CAST(({end}) - greatest({start}, 0) AS BIGINT))"


def pos(hay: str, needle: str) -> str:
    """0-based position, -1 if none."""
    return f"(strpos({hay}, {q(needle)}) - 1)"


def any_in(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def parse_date(x: str) -> str:
    def numeric(p):
        g = [f"regexp_extract({x}, {rx(p)}, {k})" for k in (1, 2, 3)]
        return f"WHEN regexp_matches({x}, {rx(p)}) THEN {g[2]} || '-' || lpad({g[0]}, 2, '0') || '-' || lpad({g[1]}, 2, '0') "

    p = rx(V.MONTH_NAME_DATE)
    month = "CASE lower(regexp_extract({x}, {p}, 1)) ".format(x=x, p=p)
    month += " ".join(f"WHEN '{m.lower()}' THEN '{i:02d}'" for i, m in enumerate(V.MONTHS, 1)) + " END"
    named = (
        f"WHEN regexp_matches({x}, {p}) THEN regexp_extract({x}, {p}, 3) || '-' || {month}"
        f" || '-' || lpad(regexp_extract({x}, {p}, 2), 2, '0') "
    )
    return f"(CASE {numeric(V.NUMERIC_DATE)}{named}{numeric(V.DASHED_DATE)}END)"


def padded(x: str) -> str:
    return f"regexp_matches({strip(x)}, {q(V.PADDED_NUMERIC_DATE)})"


def is_true(field: str, x: str) -> str:
    low = f"lower({x})"
    listed = ", ".join(q(f) for f in V.AMBIGUOUS_FIELDS)
    return (
        f"(CASE WHEN {any_in(field, V.FILING_FIELD_INDICATORS)} THEN {any_in(low, V.FILING_FIELD_CONTEXT)}"
        f" WHEN {any_in(field, V.INCIDENT_FIELD_INDICATORS)} THEN true"
        f" WHEN {any_in(low, V.INCIDENT_CONTEXT)} THEN true"
        f" WHEN {field} IN ({listed}) AND NOT {any_in(low, V.AMBIGUOUS_CONTEXT)} THEN false"
        f" WHEN {padded(x)} THEN false ELSE true END)"
    )


def bare(part: str) -> str:
    return strip(f"split_part({part}, ' (', 1)")


def best_group(x: str, pattern: str) -> str:
    whole = f"nullif(regexp_extract({x}, {rx(pattern)}, 0), '')"
    if group_count(pattern) == 0:
        return whole
    return f"coalesce(nullif(regexp_extract({x}, {rx(pattern)}, 1), ''), {whole})"


def spans_cte(name: str, source: str, pattern_sql: str, number: int, extra: str = "") -> str:
    """Rows (filing_id, pat, i, start, v) of all matches."""
    return f"""{name} AS (
  SELECT filing_id, {number} AS pat, i,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start,
    m[i] AS v, text
  FROM (SELECT filing_id, text, g, m, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT filing_id, text, regexp_extract_all(text, {pattern_sql}) AS m,
      string_split_regex(text, {pattern_sql}) AS g FROM {source})))"""


# --- one builder per rule type; each returns (extra CTEs, expression or CTE name) ---


def f1(rule):
    return f"nullif(regexp_extract(text, {rx(rule['regex'])}, 0), '')"


def f3(rule):
    starts = " ".join(
        f"WHEN contains(lower(text), {q(k.lower())}) THEN {pos('lower(text)', k.lower())} + {len(k)}"
        for k in rule["start_keywords"]
    )
    start = f"(CASE {starts} END)"
    ends = [
        f"CASE WHEN strpos(substr(lower(text), {start} + 1), {q(k.lower())}) > 0"
        f" THEN {start} + strpos(substr(lower(text), {start} + 1), {q(k.lower())}) - 1 END"
        for k in rule["end_keywords"]
    ]
    end = f"least(length(text), {', '.join(ends)})"
    return f"nullif({strip(f'substr(text, {start} + 1, {end} - {start})')}, '')"


def f4(rule):
    group = 1 if group_count(rule["date_regex"]) else 0
    before, after = V.FACTS_WINDOW
    out = ""
    for k in rule["keywords"]:
        at = pos("lower(text)", k.lower())
        near = window("text", f"{at} - {before}", f"{at} + {after}")
        out += (
            f" WHEN {at} >= 0 AND regexp_matches({near}, {rx(rule['date_regex'])})"
            f" THEN regexp_extract({near}, {rx(rule['date_regex'])}, {group})"
        )
    return f"nullif(CASE{out} END, '')"


def f5(rule):
    before, after = V.TITLE_WINDOW
    tries = []
    for k in rule.get("keywords", V.TITLE_KEYWORDS):
        at = pos("text", k)
        near = window("text", f"{at} - {before}", f"{at} + {after}")
        clean = strip(f"regexp_replace({strip('x')}, {q(V.TITLE_CASE_NUMBER)}, '', 'g')")
        lines = f"list_filter(string_split({near}, chr(10)), lambda x: contains(x, {q(k)}))"
        titles = f"list_filter(list_transform({lines}, lambda x: {clean}), lambda x: length(x) > {V.TITLE_MIN_LENGTH})"
        tries.append(f"CASE WHEN {at} >= 0 THEN {titles}[1] END")
    return f"coalesce({', '.join(tries)})"


def f6(rule):
    variants = fuzzy_variants(rule["base_patterns"])
    before, after = V.FUZZY_WINDOW
    tries = []
    for k in rule["context_keywords"]:
        at = pos("lower(text)", k.lower())
        near = window("text", f"{at} - {before}", f"{at} + {after}")
        found = ", ".join(best_group(near, v) for v in variants)
        tries.append(f"CASE WHEN {at} >= 0 THEN coalesce({found}) END")
    tries += [best_group("text", v) for v in variants]
    return f"coalesce({', '.join(tries)})"


def f7(rule, source):
    import re

    r = rule["search_radius"]
    ctes = [
        spans_cte(f"k{i}", source, rx(re.escape(k)), i) for i, k in enumerate(rule["primary_keywords"])
    ]
    union = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(ctes)))
    score = "1.0::DOUBLE" + "".join(
        f" + CASE WHEN contains(lower(near), {q(k.lower())}) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
        for k in rule["secondary_keywords"]
    )
    value = ", ".join(best_group("near", t) for t in rule["target_patterns"])
    ctes.append(
        f"near7 AS (SELECT *, {window('text', f'start - {r}', f'start + {r}')} AS near FROM ({union}))"
    )
    ctes.append(
        f"""f7 AS (SELECT filing_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY score DESC, pat, start) AS rn FROM (
    SELECT filing_id, pat, start, {score} AS score, coalesce({value}) AS value FROM near7)
  WHERE value IS NOT NULL) WHERE rn = 1)"""
    )
    return ctes


def f8(rule, source):
    listed = rule["patterns"]
    ctes = [spans_cte(f"m{i}", source, rx(p["regex"]), i) for i, p in enumerate(listed)]
    bonus = [0.0]
    for _ in V.SCORED_CONTEXT_WORDS:
        bonus.append(bonus[-1] + V.SCORED_WORD_WEIGHT)
    rows = []
    for i, p in enumerate(listed):
        rows.append(
            f"SELECT filing_id, pat, start, v, text, {best_group('v', p['regex'])} AS value,"
            f" {float(p.get('weight', 1.0)) * (len(listed) - i)!r}::DOUBLE AS base FROM m{i}"
        )
    near = f"lower({window('text', f'start - {V.SCORED_CONTEXT}', f'start + length(v) + {V.SCORED_CONTEXT}')})"
    words = " + ".join(f"contains({near}, '{w}')::INT" for w in V.SCORED_CONTEXT_WORDS)
    steps = ", ".join(f"{b!r}::DOUBLE" for b in bonus)
    ctes.append(
        f"""f8 AS (SELECT filing_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY score DESC, pat, start) AS rn FROM (
    SELECT filing_id, pat, start, value,
      base + length(value) * {V.SCORED_LENGTH_WEIGHT!r}::DOUBLE + ([{steps}])[{words} + 1] AS score
    FROM ({' UNION ALL '.join(rows)})))
  WHERE rn = 1)"""
    )
    return ctes


def f9(rule, source):
    r = rule["context_radius"]
    ctes = [spans_cte(f"d{i}", source, rx(p), i) for i, p in enumerate(rule["date_patterns"])]
    union = " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(len(ctes)))
    near = f"lower({window('text', f'start - {r}', f'start + length(v) + {r}')})"
    listed = "[" + ", ".join(q(x.lower()) for x in rule["incident_indicators"]) + "]"
    ctes.append(
        f"""dated AS (SELECT *, row_number() OVER (PARTITION BY filing_id, std ORDER BY pat, i) AS dup FROM (
  SELECT filing_id, pat, i, start, v, {parse_date('v')} AS std, {near} AS near FROM ({union})
  WHERE NOT {padded('v')}))"""
    )
    ctes.append(
        f"""scored AS (SELECT *, list_filter({listed}, lambda x: contains(near, x)) AS hits
  FROM dated WHERE std IS NULL OR dup = 1)"""
    )
    ctes.append(
        f"""f9 AS (SELECT filing_id, string_agg(label, ' | ' ORDER BY rn) AS value FROM (
  SELECT filing_id, CASE WHEN len(hits) > 0 THEN v || ' (' || array_to_string(hits[1:{V.MULTI_DATE_SHOWN_INDICATORS}], ', ') || ')' ELSE v END AS label,
    row_number() OVER (PARTITION BY filing_id ORDER BY -len(hits), start, pat) AS rn FROM scored)
  WHERE rn <= {V.MULTI_DATE_TOP} GROUP BY filing_id)"""
    )
    return ctes


def emails(x="text"):
    found = f"list_sort(list_distinct(regexp_extract_all({x}, {q(V.EMAIL)})))"
    return f"nullif(array_to_string(list_filter({found}, lambda e: length(e) > {V.EMAIL_MIN_LENGTH}), ', '), '')"


def elements_ctes(source: str) -> list[str]:
    return [
        f"""raw_lines AS (SELECT filing_id, i - 1 AS line_no, {strip('l[i]')} AS text, {strip("coalesce(l[i-1], '')")} AS prev
  FROM (SELECT filing_id, l, unnest(range(1, len(l) + 1)) AS i FROM
    (SELECT filing_id, string_split(text, chr(10)) AS l FROM {source} WHERE text IS NOT NULL)))""",
        """layout_elements AS (SELECT filing_id, 0 AS page,
    CAST(row_number() OVER (PARTITION BY filing_id ORDER BY line_no) - 1 AS INTEGER) AS elem_idx, text,
    CASE WHEN line_no > 0 AND prev LIKE '%:' THEN 200.0 ELSE 72.0 END::DOUBLE AS x0,
    (CASE WHEN line_no > 0 AND prev LIKE '%:' THEN 200.0 ELSE 72.0 END + 6.0 * length(text))::DOUBLE AS x1,
    (760.0 - 12.0 * CASE WHEN line_no > 0 AND prev LIKE '%:' THEN line_no - 1 ELSE line_no END)::DOUBLE AS y0
  FROM raw_lines WHERE length(text) > 0)""",
    ]


def f2_cte(name: str, rule: dict) -> str:
    keys = ", ".join(f"({i}, {q(k.lower())})" for i, k in enumerate(rule["keywords"]))
    cut = "j"
    for d in reversed(rule.get("extract_until", [])):
        cut = f"CASE WHEN contains(j, {q(d)}) THEN split_part(j, {q(d)}, 1) ELSE {cut} END"
    return f"""{name} AS (SELECT filing_id, nullif({strip(cut)}, '') AS value FROM (
  SELECT filing_id, j, row_number() OVER (PARTITION BY filing_id ORDER BY kw, hit) AS best FROM (
    SELECT filing_id, kw, hit, string_agg(text, ' ' ORDER BY elem_idx) AS j FROM (
      SELECT a.filing_id, kw, a.elem_idx AS hit, b.elem_idx, b.text,
        row_number() OVER (PARTITION BY a.filing_id, kw, a.elem_idx ORDER BY b.elem_idx) AS nth
      FROM layout_elements a JOIN (VALUES {keys}) AS k(kw, word) ON contains(lower(a.text), word)
      JOIN layout_elements b ON a.filing_id = b.filing_id AND b.elem_idx BETWEEN a.elem_idx + 1 AND a.elem_idx + {V.FOLLOWING_ELEMENTS}
        AND a.page = b.page AND abs(b.y0 - a.y0) < {V.LINE_TOLERANCE} AND b.x0 - a.x1 < {rule.get('max_distance', 150)})
    WHERE nth <= {rule.get('extract_words', 1)} GROUP BY filing_id, kw, hit)) WHERE best = 1)"""


SCALAR = {"regex": f1, "section_pattern": f3, "facts_pattern": f4, "case_title": f5, "fuzzy_date": f6}
ROWWISE = {"contextual_search": f7, "multi_pattern": f8, "multi_date": f9}


def fields_ctes(source: str) -> list[str]:
    """CTE ``fields``: filing_id and one column per rule of the shipped pack."""
    ctes = elements_ctes(source)
    columns, joins = [], []
    for name in PACK.fields:
        rule = PACK.rules[name]
        kind = rule["type"]
        if kind in SCALAR:
            columns.append(f"{SCALAR[kind](rule)} AS {name}")
        elif kind == "nearest_word":
            ctes.append(f2_cte(f"e_{name}", rule))
            joins.append((f"e_{name}", name))
        else:
            new = ROWWISE[kind](rule, source)
            ctes += new
            joins.append((new[-1].split(" ")[0], name))
    picked = ", ".join(f"{alias}.value AS {name}" for alias, name in joins)
    left = " ".join(f"LEFT JOIN {alias} USING (filing_id)" for alias, _ in joins)
    ctes.append(f"scalars AS (SELECT filing_id, {', '.join(columns)} FROM {source})")
    ctes.append(f"fields AS (SELECT scalars.*, {picked} FROM scalars {left})")
    return ctes


def contact_ctes(source: str, phrases=V.BATCH_TRIGGERS, ignore_case=True) -> list[str]:
    """CTE ``contacts``: exact triggers only."""
    low = (lambda x: f"lower({x})") if ignore_case else (lambda x: x)
    words = [p.lower() if ignore_case else p for p in phrases]
    at = " ".join(
        f"WHEN contains({low('line')}, {q(w)}) THEN {pos(low('line'), w)}" for w in words
    )
    return [
        f"""clines AS (SELECT filing_id, text, i, l[i] AS line,
    CAST(coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS off
  FROM (SELECT filing_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM
    (SELECT filing_id, text, string_split(text, chr(10)) AS l FROM {source} WHERE text IS NOT NULL)))""",
        f"""trig AS (SELECT filing_id, text, off + (CASE {at} END) AS idx FROM (
  SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY i) AS rn FROM clines
  WHERE {any_in(low('line'), words)}) WHERE rn = 1)""",
        f"contacts AS (SELECT filing_id, idx, {clean_contact(f'substr(text, idx + 1, {V.CONTACT_WINDOW})')} AS contact FROM trig)",
    ]


def clean_contact(x: str, keep_blank=False) -> str:
    lines = f"string_split({x}, chr(10))"
    if not keep_blank:
        lines = f"list_filter(list_transform({lines}, lambda s: {strip('s')}), lambda s: length(s) > 0)"
    kept = f"list_filter({lines}, lambda s: NOT {any_in('lower(s)', V.CONTACT_REMOVE_TERMS)})"
    cuts = f"list_position(list_transform({kept}, lambda s: {any_in('lower(s)', V.CONTACT_CUTOFF_TERMS)}), true)"
    cut = f"CASE WHEN coalesce({cuts}, 0) > 0 THEN ({kept})[1:{cuts}-1] ELSE {kept} END"
    return f"nullif(array_to_string({cut}, chr(10)), '')"


def results_ctes(source: str, counties: list[str] | None = None, skip=V.KNOWN_FILING_DATES) -> list[str]:
    """CTE ``results``: the full extraction result per filing."""
    ctes = fields_ctes(source) + contact_ctes(source)
    listed = [f for f in PACK.fields if f in DATE_FIELDS]
    applies = "true" if counties is None else "county IN (" + ", ".join(q(c) for c in counties) + ")"
    union = " UNION ALL ".join(
        f"SELECT filing_id, {i} AS ord, {q(f)} AS field, {f} AS value FROM fields WHERE {f} IS NOT NULL"
        for i, f in enumerate(listed)
    )
    skipped = ", ".join(q(s) for s in skip)
    ctes += [
        f"""cand AS (SELECT u.*, {parse_date('value')} AS std, {is_true('field', 'value')} AS tru
  FROM ({union}) u JOIN {source} s USING (filing_id) WHERE {applies})""",
        """prim AS (SELECT filing_id, value, field, std FROM (SELECT *, row_number() OVER (
    PARTITION BY filing_id ORDER BY tru::INT DESC, length(value) DESC, ord) AS rn FROM cand) WHERE rn = 1)""",
        "own AS (SELECT filing_id, ord AS seq, value AS orig, std, field FROM cand WHERE tru AND std IS NOT NULL)",
        f"""parts AS (SELECT filing_id, 1000 + n AS seq, p AS orig, {parse_date(bare('p'))} AS std, {q(V.MULTI_DATE_FIELD)} AS field
  FROM (SELECT filing_id, unnest(l) AS p, unnest(range(len(l))) AS n FROM (
    SELECT filing_id, string_split(value, ' | ') AS l FROM cand WHERE field = {q(V.MULTI_DATE_FIELD)}))
  WHERE NOT {padded(bare('p'))} AND {bare('p')} NOT IN ({skipped}))""",
        """extra AS (SELECT filing_id, seq, orig, std, field FROM (SELECT *, row_number() OVER (
    PARTITION BY filing_id, std ORDER BY seq) AS rn FROM parts p WHERE std IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM own o WHERE o.filing_id = p.filing_id AND o.std = p.std)) WHERE rn = 1)""",
        "trues AS (SELECT * FROM own UNION ALL SELECT * FROM extra)",
        """ends AS (SELECT filing_id, arg_min({'orig': orig, 'std': std, 'field': field}, {'std': std, 'seq': seq}) AS f,
    arg_max({'orig': orig, 'std': std, 'field': field}, {'std': std, 'seq': seq}) AS l FROM trues GROUP BY filing_id)""",
        "counted AS (SELECT filing_id, count(*) FILTER (WHERE std IS NOT NULL) AS n_dates, coalesce(bool_or(tru AND std IS NOT NULL), false) AS any_true FROM cand GROUP BY filing_id)",
        f"""joined AS (SELECT s.*, prim.value AS pv, prim.field AS pf, prim.std AS ps, ends.f AS f, ends.l AS l,
    coalesce(n_dates, 0) AS n_dates, coalesce(any_true, false) AS any_true, contact, {applies} AS has_pack,
    CASE WHEN s.text IS NULL THEN 'document text is missing'
      WHEN ends.f IS NOT NULL AND prim.value IS NOT NULL AND prim.std IS NULL THEN {q(V.NULL_COMPARE_ERROR)} END AS error
  FROM {source} s LEFT JOIN prim USING (filing_id) LEFT JOIN ends USING (filing_id)
    LEFT JOIN counted USING (filing_id) LEFT JOIN contacts USING (filing_id))""",
        f"""results AS (SELECT * EXCLUDE (f, l, pv, pf, ps, contact, n_dates, any_true),
    CASE WHEN error IS NULL THEN n_dates END AS n_dates, CASE WHEN error IS NULL THEN any_true END AS any_true,
    CASE WHEN error IS NULL THEN CASE WHEN f IS NOT NULL AND (pv IS NULL OR f.std < ps) THEN f.orig ELSE pv END END AS incident_date,
    CASE WHEN error IS NULL THEN CASE WHEN f IS NOT NULL AND (pv IS NULL OR f.std < ps) THEN f.field ELSE pf END END AS incident_source_field,
    CASE WHEN error IS NULL AND f.std <> l.std THEN l.orig END AS incident_end_date,
    CASE WHEN error IS NULL AND f.std <> l.std THEN l.field END AS incident_end_source_field,
    CASE WHEN error IS NULL THEN {emails()} END AS emails,
    CASE WHEN error IS NULL THEN contact END AS plaintiff_contact FROM joined)""",
    ]
    return ctes


def sql(ctes: list[str], select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"
