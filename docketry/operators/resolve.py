"""From field values to one incident date or date range per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.compiled import compiled
from ..functions.text import let
from ..functions.dates import (
    date_parts,
    from_parts,
    incident_kind,
    is_date_field,
    is_padded_numeric,
    is_true_incident,
    parse_date,
    split_multi,
    without_context,
)


DATE_COLUMNS = (
    "incident_date", "incident_source_field", "incident_end_date", "incident_end_source_field",
    "all_incident_dates",
)


def candidate_array(fields: list[str], column=F.col) -> Column:
    """Date fields with a value, in extraction order.

    ``array<struct<field, value, is_incident, standard_date, order>>``
    """
    listed = [f for f in fields if is_date_field(f)]
    if not listed:
        return F.expr(
            "cast(array() as array<struct<field:string,value:string,is_incident:boolean,"
            "standard_date:string,order:int>>)"
        )
    filled = F.array_compact(
        F.array(
            *[
                F.when(
                    column(field).isNotNull(),
                    F.struct(
                        F.lit(field).alias("field"), column(field).alias("value"),
                        F.lit(order).alias("order"), F.lit(incident_kind(field)).alias("kind"),
                    ),
                )
                for order, field in enumerate(listed)
            ]
        )
    )
    searched = F.transform(
        filled, lambda c: F.struct(c.alias("of"), F.lower(c["value"]).alias("low"), date_parts(c["value"]).alias("parts"))
    )
    return F.transform(
        searched,
        lambda x: F.struct(
            x["of"]["field"].alias("field"),
            x["of"]["value"].alias("value"),
            is_true_incident(x["of"]["field"], x["of"]["value"], x["of"]["kind"], x["low"]).alias("is_incident"),
            from_parts(x["parts"]).alias("standard_date"),
            x["of"]["order"].alias("order"),
        ),
    )


def all_incident_dates(candidates: Column) -> Column:
    """Candidates with a parseable date, in the published shape."""
    parsed = F.filter(candidates, lambda c: c["standard_date"].isNotNull())
    return F.transform(
        parsed,
        lambda c: F.struct(
            c["value"].alias("original_date"),
            c["standard_date"].alias("standard_date"),
            c["field"].alias("source_field"),
            c["is_incident"].alias("is_incident"),
        ),
    )


def primary_candidate(candidates: Column) -> Column:
    """The winning candidate: true dates first, then the longest, then the earliest field."""
    return F.array_max(
        F.transform(
            candidates,
            lambda c: F.struct(
                c["is_incident"].alias("is_incident"),
                F.length(c["value"]).alias("length"),
                (-c["order"]).alias("by_order"),
                c["value"].alias("value"),
                c["field"].alias("field"),
            ),
        )
    )


def _dated(original: Column, standard: Column, field: Column) -> Column:
    return F.struct(
        standard.alias("standard_date"),
        original.alias("original_date"),
        field.alias("source_field"),
    )


def true_dates(all_dates: Column, multi_value: Column, skip=V.KNOWN_FILING_DATES) -> Column:
    """True incident dates plus those only the multi-date field holds, sorted by date."""
    own = F.transform(
        F.filter(all_dates, lambda d: d["is_incident"]),
        lambda d: _dated(d["original_date"], d["standard_date"], d["source_field"]),
    )
    usable = multi_value.isNotNull() & (multi_value != V.NOT_AVAILABLE)
    parts = F.transform(
        F.when(usable, split_multi(multi_value)),
        lambda p: F.struct(p.alias("part"), without_context(p).alias("bare")),
    )
    listed = F.filter(
        parts, lambda p: ~is_padded_numeric(p["bare"]) & ~p["bare"].isin(*skip) if skip
        else ~is_padded_numeric(p["bare"])
    )
    extra = F.transform(
        F.transform(listed, lambda p: F.struct(p["part"].alias("part"), date_parts(p["bare"]).alias("date"))),
        lambda p: _dated(p["part"], from_parts(p["date"]), F.lit(V.MULTI_DATE_FIELD)),
    )
    extra = F.filter(extra, lambda d: d["standard_date"].isNotNull())

    def number(dates, kind):
        return F.transform(
            dates,
            lambda d, i: F.struct(
                d["standard_date"].alias("standard_date"), F.lit(kind).alias("extra"), i.alias("seq"),
                d["original_date"].alias("original_date"), d["source_field"].alias("source_field"),
            ),
        )

    def new_or_own(sorted_dates):
        # own dates all stay; an extra one is kept if it is the first of its date and no own one has it
        return F.filter(
            sorted_dates,
            lambda d, i: (d["extra"] == 0)
            | (i == 0)
            | (F.get(sorted_dates, i - 1)["standard_date"] != d["standard_date"]),
        )

    none = F.expr("cast(array() as array<struct<standard_date:string,extra:int,seq:int,original_date:string,source_field:string>>)")
    every = F.concat(number(own, 0), F.coalesce(number(extra, 1), none))
    return let(F.sort_array(every), new_or_own)


def resolve_dates(
    df: DataFrame,
    fields: list[str],
    *,
    column=F.col,
    skip=V.KNOWN_FILING_DATES,
    null_safe: bool = False,
    candidates: Column | None = None,
) -> DataFrame:
    """Add the date result columns to a frame of field values.

    ``candidates`` replaces the candidate array of ``fields``, where the order of the fields differs by row.

    A true date cannot be compared with a primary value that holds no date:
    such a document becomes an error row, or takes the earliest true date when
    ``null_safe``.  Steps are separate projections, so no array is built twice.
    """
    if candidates is None:
        candidates = compiled(("candidates", tuple(fields), column), lambda: candidate_array(fields, column))
    df = df.withColumn("_candidates", candidates)
    for columns in compiled(
        ("resolve", V.MULTI_DATE_FIELD in fields, column, tuple(skip), null_safe),
        lambda: _resolution_steps(fields, column, skip, null_safe),
    ):
        df = df.withColumns(columns)
    return df.drop("_candidates", "_primary", "_true", "_primary_date", "_first", "_last")


def _resolution_steps(fields, column, skip, null_safe) -> list[dict[str, Column]]:
    multi = column(V.MULTI_DATE_FIELD) if V.MULTI_DATE_FIELD in fields else F.lit(None).cast("string")
    first = F.get("_true", F.lit(0))
    last = F.get("_true", F.size("_true") - 1)
    has_true = F.col("_first").isNotNull()
    uncomparable = has_true & F.col("_primary").isNotNull() & F.col("_primary_date").isNull()
    earlier = has_true & (
        F.col("_primary").isNull() | (F.col("_first.standard_date") < F.col("_primary_date"))
    )
    if null_safe:
        earlier = earlier | uncomparable
        error = F.lit(None).cast("string")
    else:
        error = F.when(uncomparable, F.lit(V.NULL_COMPARE_ERROR))
    earlier = F.coalesce(earlier, F.lit(False))
    is_range = has_true & (F.col("_first.standard_date") != F.col("_last.standard_date"))

    def either(kind, of_true, of_primary):
        return {kind: F.when(earlier, F.col(of_true)).otherwise(F.col(of_primary))}

    return [
        {
            "all_incident_dates": all_incident_dates(F.col("_candidates")),
            "_primary": primary_candidate(F.col("_candidates")),
        },
        {
            "_true": true_dates(F.col("all_incident_dates"), multi, skip),
            "_primary_date": parse_date(F.col("_primary.value")),
        },
        {"_first": first, "_last": last},
        {
            **either("incident_date", "_first.original_date", "_primary.value"),
            **either("incident_source_field", "_first.source_field", "_primary.field"),
            "incident_end_date": F.when(is_range, F.col("_last.original_date")),
            "incident_end_source_field": F.when(is_range, F.col("_last.source_field")),
            "date_error": error,
        },
    ]
