"""Numbers in written reports traced back to the evidence they were written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions.text import (
    EVIDENCE_NUMBER,
    POINT_UNITS,
    REPORT_NOISE,
    REPORT_NUMBER,
    TRIVIAL_NUMBERS,
    decimals,
    numbers,
)
from shiftlens.operators.ordering import null_safe_join, position


def evidence_numbers(texts: Column) -> Column:
    """Distinct sorted numbers of array<string> evidence; ``x%`` stands for x and x/100."""
    found = F.flatten(F.transform(texts, lambda t: numbers(t, EVIDENCE_NUMBER)))
    both = F.flatten(
        F.transform(
            found,
            lambda f: F.when(f["unit"] != "", F.array(f["value"], f["value"] / 100)).otherwise(
                F.array(f["value"])
            ),
        )
    )
    return F.array_sort(F.array_distinct(both))


def clean_report(report: Column) -> Column:
    """The report without dates, ranges, indexed field names and period codes."""
    for pattern in REPORT_NOISE:
        report = F.regexp_replace(report, pattern, " ")
    return report


def report_numbers(report: Column) -> Column:
    """Numbers of a report that need evidence."""
    trivial = F.array(*[F.lit(float(n)) for n in TRIVIAL_NUMBERS])
    return F.filter(
        numbers(clean_report(report), REPORT_NUMBER),
        lambda x: (x["unit"] != "") | ~F.array_contains(trivial, F.abs(x["value"])),
    )


def _matches(item: Column, pool: Column, rates: Column) -> Column:
    size = F.abs(item["value"])
    tol = F.lit(0.5) * F.pow(F.lit(10.0), -decimals(item["raw"])) + F.lit(1e-9)
    has_unit = item["unit"] != ""
    plain = F.exists(pool, lambda c: F.abs(F.abs(c) - size) <= tol)
    scaled = has_unit & F.exists(pool, lambda c: F.abs(F.abs(c * 100) - size) <= tol)

    # the rates are sorted: the last one that is not too far above ``a`` decides for ``a``
    def apart(a: Column) -> Column:
        n = position(a + (size + tol) / 100, rates, F.size(rates))
        return F.coalesce((F.get(rates, n - 1) - a) * 100 >= size - tol, F.lit(False))

    gap = item["unit"].isin(POINT_UNITS) & F.exists(rates, apart)
    return plain | scaled | gap


def ungrounded(reports: DataFrame, report: str, evidence: str) -> DataFrame:
    """Add ``ungrounded array<string>``: the report's numbers without evidence, in order.

    ``evidence`` is an array<string> column. Without any number in it nothing is reported.
    """
    parsed = reports.withColumn("__pool", evidence_numbers(F.col(evidence))).withColumn(
        "__nums", report_numbers(F.col(report))
    )
    pool = F.col("__pool")
    rates = F.filter(pool, lambda x: (x >= 0) & (x <= 1))
    missing = F.filter("__nums", lambda x: ~_matches(x, F.col("__pool"), F.col("__rates")))
    written = F.transform(missing, lambda x: F.concat(x["raw"], x["unit"]))
    return (
        parsed.withColumn("__rates", rates)
        .withColumn(
            "ungrounded",
            F.when(F.size(pool) > 0, F.array_distinct(written)).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .drop("__pool", "__nums", "__rates")
    )


def banded(numbers: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``numbers`` that no number of ``pool`` with the same keys is close to.

    ``numbers`` holds ``raw, unit, value`` as they are written and ``pool`` holds ``value``. Both sides meet by
    equality of the band that they lie in: bands are as wide as the last written place, which is twice
    the tolerance, so what is close lies in the same band or in one beside it. A hot key's numbers are
    spread over their bands, and no list of a key is ever formed. Numbers with a unit also match a hundredth
    of theirs; differences of rates are not looked at here.
    """
    step = decimals(F.col("raw"))
    tol = F.lit(0.5) * F.pow(F.lit(10.0), -step) + F.lit(1e-9)
    items = numbers.withColumns(
        {
            "__id": F.struct(*numbers.columns),
            "__size": F.abs("value"),
            # beyond eight places the fixed part of the tolerance is wider than a band would be
            "__step": F.least(step, F.lit(8)),
            "__tol": tol,
        }
    )
    sides = pool.where("value IS NOT NULL").select(*keys, F.abs("value").alias("__held")).distinct()
    scaled = sides.select(*keys, (F.col("__held") * 100).alias("__held"), F.lit(True).alias("__percent"))
    both = sides.withColumn("__percent", F.lit(False)).unionByName(scaled)

    def band(size: Column) -> Column:
        return F.floor(F.least(size * F.pow(F.lit(10.0), F.col("__step")), F.lit(1e18)))

    # only steps that some number of the key is written with
    steps = items.select(*keys, "__step").distinct()
    around = F.explode(F.sequence(band(F.col("__held")) - 1, band(F.col("__held")) + 1))
    placed = null_safe_join(both, steps, keys).withColumn("__band", around)
    wanted = items.withColumn("__band", band(F.col("__size")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    close = (
        same
        & (F.col("a.__step") == F.col("b.__step"))
        & (F.col("a.__band") == F.col("b.__band"))
        & (F.abs(F.col("b.__held") - F.col("a.__size")) <= F.col("a.__tol"))
        & (~F.col("b.__percent") | (F.col("a.unit") != ""))
    )
    missing = wanted.alias("a").join(placed.alias("b"), close, "left_anti")
    return missing.select(*[F.col(f"__id.{c}").alias(c) for c in numbers.columns])


def rate_differences(evidence: DataFrame, keys: list[str], texts: str) -> DataFrame:
    """``keys, n_rates, max_diff`` — how far apart the rates of one piece of evidence lie."""
    pool = evidence_numbers(F.col(texts))
    rates = F.filter(pool, lambda x: (x >= 0) & (x <= 1))
    return evidence.select(*keys, rates.alias("__r")).select(
        *keys,
        F.size("__r").alias("n_rates"),
        (F.array_max("__r") - F.array_min("__r")).alias("max_diff"),
    )
