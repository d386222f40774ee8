"""The extraction plan: filings and rule packs in, one result row per filing out.

One narrow stage over one scan: no shuffle, no join, however many packs.  Input columns: ``text``, ``county``,
optionally ``elements`` (array of layout elements); all other columns pass
through.  Only what the asked outputs need is put into the plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.compiled import compiled
from ..functions.dates import is_date_field
from ..functions.text import bind
from ..operators.contact import add_contact
from ..operators.layout import ELEMENT_TYPE, joined_texts, nearest_word_join
from ..operators.resolve import DATE_COLUMNS, candidate_array, resolve_dates
from ..operators.rules import RULE_TYPES, Doc, Shared, emails, rule_column, shared_of
from ..sources.packs import RulePack, merge_equal

MISSING_TEXT = "document text is missing"
RESULT_COLUMNS = (
    "incident_date", "incident_source_field", "incident_end_date", "incident_end_source_field",
    "all_incident_dates", "emails", "plaintiff_contact", "extracted_data", "error",
)
#: The multi-date field on its own, for those that need no other field: only where it is asked for.
MULTIPLE_DATES = "multiple_dates"


def field_column(field: str) -> Column:
    return F.col(f"field_{field}")


def _typed_array(kind: str) -> Column:
    return F.lit(None).cast(f"array<{kind}>")


def with_fields(
    filings: DataFrame, packs: RulePack | Iterable[RulePack], *, only: Iterable[str] | None = None
) -> DataFrame:
    """Add ``field_<name>`` for every field of the packs (or for ``only`` some).

    With one pack all rows are read by it; with several each row by the pack of its county.  A rule that several
    packs share is one expression, evaluated where one of their counties stands.
    """
    packs = [packs] if isinstance(packs, RulePack) else list(packs)
    by_county = len(packs) > 1
    return _with_fields(filings, packs, F.lit(True), by_county, only, bind)


def _key(rule: dict) -> str:
    return json.dumps(rule, sort_keys=True)


def _with_fields(
    filings: DataFrame, packs: list[RulePack], applies: Column, by_county: bool, only, add=DataFrame.withColumns, found=None
) -> DataFrame:
    """``found`` names the columns that hold what rules, by their text, have found elsewhere.

    ``add`` is ``bind`` where filters on fields may follow: pushed below plain columns they would carry a copy of
    every step that made the field."""
    wanted = None if only is None else set(only)
    # field -> rule as text -> counties whose packs have it
    users: dict[str, dict[str, list[str]]] = {}
    rules: dict[str, dict] = {}
    for pack in packs:
        for field in dict.fromkeys(pack.fields):
            if wanted is None or field in wanted:
                key = _key(pack.rules[field])
                rules[key] = pack.rules[field]
                users.setdefault(field, {}).setdefault(key, []).extend(pack.counties)
    if not users:
        return filings
    every = {c for pack in packs for c in pack.counties}
    shared = shared_of(rules.values())
    text, elements = F.when(applies, F.col("text")), _typed_array(ELEMENT_TYPE)
    if "elements" in filings.columns:
        elements = F.when(applies, F.col("elements"))
    step = filings.withColumns({"_text": text, "_elements": elements})
    step = step.withColumns({"_lower": F.lower("_text"), "_element_texts": joined_texts(F.col("_elements"))})
    for columns in compiled(("shared", shared), shared.columns):
        step = step.withColumns(columns)
    fields = {}
    for field, by_rule in users.items():
        value = None
        for key, counties in by_rule.items():
            column = F.when(applies, F.col(found[key])) if found and key in found else _compiled_rule(rules[key], shared)
            if by_county and set(counties) != every:
                own = F.col("county").isin(sorted(set(counties)))
                value = F.when(own, column) if value is None else value.when(own, column)
            else:
                value = column
        fields[f"field_{field}"] = value
    return add(step, fields).drop("_text", "_lower", "_elements", "_element_texts", *shared.names())


def _compiled_rule(rule: dict, shared: Shared) -> Column:
    """Column of a rule over ``_text``, ``_lower``, ``_elements``, ``_element_texts``, ``_pages`` and what rules share."""
    key = ("rule", RULE_TYPES.get(rule.get("type", "")), _key(rule), shared)
    doc = Doc(F.col("_text"), F.col("_lower"), F.col("_elements"), shared, F.col("_pages"), F.col("_element_texts"))
    return compiled(key, lambda: rule_column(rule, doc))


def extracted_map(fields: list[str]) -> Column:
    """The recorded fields as a map; fields without a value are absent."""
    names = list(dict.fromkeys(fields))
    if not names:
        return F.expr("cast(map() as map<string,string>)")
    full = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[field_column(n) for n in names])
    )
    return F.map_filter(full, lambda _, v: v.isNotNull())


def _by_fields(packs: list[RulePack], make: Callable[[list[str]], Column]) -> Column:
    """``make`` of the fields of each row's pack, in that pack's order; once for packs that agree."""
    orders: dict[tuple[str, ...], list[str]] = {}
    for pack in packs:
        orders.setdefault(tuple(pack.fields), []).extend(pack.counties)
    if not orders:
        return make([])
    if len(orders) == 1:
        # fields are NULL where no pack applies
        return make(list(*orders))
    value = None
    for fields, counties in orders.items():
        own = F.col("county").isin(counties)
        value = F.when(own, make(list(fields))) if value is None else value.when(own, make(list(fields)))
    return value.otherwise(make([]))


def _first_of_each_county(packs: Iterable[RulePack]) -> list[RulePack]:
    """A county that several packs name belongs to the first of them."""
    seen: set[str] = set()
    out = []
    for pack in packs:
        own = tuple(dict.fromkeys(c for c in pack.counties if c not in seen))
        seen.update(own)
        if own:
            out.append(pack.for_counties(own))
    return out


def extract(
    filings: DataFrame,
    packs: Iterable[RulePack],
    *,
    outputs: Iterable[str] = RESULT_COLUMNS,
    null_safe: bool = False,
    fuzzy: bool = True,
    skip: tuple[str, ...] = V.KNOWN_FILING_DATES,
    county: str | None = None,
    extracted_at: Column | None = None,
    layout: DataFrame | None = None,
    key: str | None = None,
) -> DataFrame:
    """Extract with the pack of each filing's county; other counties get no fields.

    A failed document is an error row and the run goes on.  ``outputs`` names the result columns to add (``multiple_dates``
    is one more, the value of the multi-date field): rules,
    contact search and date resolution that none of them needs are not planned.  All outputs of a failed document
    are NULL, so each of them needs the date rules; no output needs none.  Of the asked columns, those that a later
    step does not select are pruned as well, but for the resolved dates: they stand behind a generator, which
    keeps filters on results from being evaluated below it a second time.

    ``county`` is the job's own county: it names all results, and its pack reads all rows.  Without it a row keeps
    its county, and rows without one are ``unknown``.  ``extracted_at`` adds ``extraction_timestamp``.

    ``layout`` is a table of layout elements, one row each, that belongs to the filings by the column ``key``; it stands
    for the ``elements`` array.  Elements meet their neighbours in a join of their own, and one row per document with a
    hit is joined in: the only shuffle of an extraction.
    """
    wanted = list(dict.fromkeys(outputs))
    unknown = set(wanted) - {*RESULT_COLUMNS, MULTIPLE_DATES}
    if unknown:
        raise ValueError(f"no such outputs: {sorted(unknown)}")
    packs = merge_equal(_first_of_each_county(packs))
    if county is not None:
        filings = filings.withColumn("county", F.lit(county))
        packs = [p.for_counties([county]) for p in packs if county in p.counties]
    kept = [c for c in filings.columns if c not in ("text", "elements", *RESULT_COLUMNS, *wanted)]
    if extracted_at is not None:
        kept = [c for c in kept if c != "extraction_timestamp"]

    step = filings
    if "emails" in wanted:
        step = step.withColumn("emails", compiled("emails", lambda: emails(F.col("text"))))
    if "plaintiff_contact" in wanted:
        step = add_contact(step, "text", "plaintiff_contact", fuzzy=fuzzy, bound=False)
    found = None
    if layout is not None and "extracted_data" in wanted:
        step, found = _with_layout(step.drop("elements"), packs, layout, key)
    if wanted:
        step = _with_dates(step, packs, wanted, skip, null_safe, found)
    if "extracted_data" in wanted:
        step = step.withColumn("extracted_data", _by_fields(packs, extracted_map))
    fine = F.col("_error").isNull()
    values = {"error": F.col("_error"), **{c: F.col(f"_{c}") for c in DATE_COLUMNS}}
    listed = any(V.MULTI_DATE_FIELD in pack.fields for pack in packs)
    values[MULTIPLE_DATES] = F.when(fine, field_column(V.MULTI_DATE_FIELD) if listed else F.lit(None).cast("string"))
    found = [values.get(c, F.when(fine, F.col(c))).alias(c) for c in wanted]
    named = F.coalesce("county", F.lit(V.DEFAULT_COUNTY)).alias("county")
    stamp = [] if extracted_at is None else [extracted_at.alias("extraction_timestamp")]
    return step.select(*[named if c == "county" else F.col(c) for c in kept], *found, *stamp)


def _with_layout(step: DataFrame, packs: list[RulePack], layout: DataFrame, key: str) -> tuple[DataFrame, dict[str, str]]:
    """What proximity rules find in the element table, a column for each distinct rule, and their names by rule."""
    rules = {_key(r): r for pack in packs for r in pack.rules.values() if r.get("type") == "nearest_word"}
    names = {k: f"_near{i}" for i, k in enumerate(rules)}
    if not rules:
        return step, names
    values = nearest_word_join(layout, {names[k]: r for k, r in rules.items()}, key)
    each = [F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names.values()]
    return step.join(values.groupBy(key).agg(*each), key, "left"), names


def _with_dates(
    step: DataFrame, packs: list[RulePack], wanted: list[str], skip, null_safe: bool, found: dict[str, str] | None
) -> DataFrame:
    """Field columns, ``_error`` and the asked date columns (named ``_<column>``) behind one generator."""
    fields = list(dict.fromkeys(f for pack in packs for f in pack.fields))
    needed = fields if "extracted_data" in wanted else [f for f in fields if is_date_field(f)]
    counties = sorted({c for pack in packs for c in pack.counties})
    applies = F.coalesce(F.col("county").isin(counties), F.lit(False))
    step = _with_fields(step, packs, applies, len(packs) > 1, needed, found=found)
    candidates = compiled(
        ("candidates", tuple((tuple(p.fields), p.counties) for p in packs)),
        lambda: _by_fields(packs, lambda own: candidate_array(own, field_column)),
    )
    step = resolve_dates(
        step, fields, column=field_column, skip=skip, null_safe=null_safe, candidates=candidates
    )
    error = F.when(F.col("text").isNull(), F.lit(MISSING_TEXT)).otherwise(F.col("date_error"))
    fine = error.isNull()
    dates = {f"_{c}": F.when(fine, F.col(c)) for c in DATE_COLUMNS if c in wanted}
    return bind(step, {"_error": error, **dates})
