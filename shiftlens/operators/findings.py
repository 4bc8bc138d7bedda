"""Checks of data and results as finding rows ``check_name, subject, severity, value``.

Every check is an aggregate, so that what reaches a caller is a handful of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shiftlens.catalog import (
    ADDITIVITY_TOLERANCE,
    COUNT_NAME,
    DIMENSIONS,
    IDENTITY_TOLERANCE,
    INDICATIVE_SAMPLE,
    MIN_SAMPLE,
    RATE_NAME,
)
from shiftlens.functions.numeric import logit
from shiftlens.operators import attribution, cohort as cohorts, monitor
from shiftlens.operators.quality import missing, undefined

COLUMNS = ["check_name", "subject", "severity", "value"]


def finding(check: str, subject: str | Column, severity: str | Column, value: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check_name"),
        (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        value.cast("double").alias("value"),
    )


def emit(row: DataFrame, candidates: list[Column]) -> DataFrame:
    """Candidates are structs or null; one row per struct that is there."""
    held = F.filter(F.array(*candidates), lambda f: f.isNotNull())
    return row.select(F.inline(held))


def sample_severity(n: Column) -> Column:
    return F.when(n < MIN_SAMPLE, "insufficient").when(n < INDICATIVE_SAMPLE, "indicative")


def sample_findings(sizes: DataFrame, subject: str, n: str = "n") -> DataFrame:
    """Groups that are too small to conclude from, or good for an indication only."""
    severity = sample_severity(F.col(n))
    return sizes.where(severity.isNotNull()).select(
        F.lit("sample_size").alias("check_name"),
        F.col(subject).cast("string").alias("subject"),
        severity.alias("severity"),
        F.col(n).cast("double").alias("value"),
    )


def is_rate_name(name: str) -> bool:
    return re.search(RATE_NAME, name) is not None


def is_count_name(name: str) -> bool:
    return re.search(COUNT_NAME, name) is not None


def result_findings(result: DataFrame) -> DataFrame:
    """Checks of a query result by column name and content, in one aggregate over it."""
    numeric = [f.name for f in result.schema.fields if isinstance(f.dataType, T.NumericType)]
    rates = [c for c in numeric if is_rate_name(c)]
    counts = [c for c in numeric if is_count_name(c)]
    counters = [c for c in numeric if is_count_name(c) or "count" in c.lower()]

    def q(c: str) -> Column:
        return F.col(f"`{c}`")

    stats = [F.count(F.lit(1)).alias("rows")]
    stats += [F.count_if(missing(result, c)).alias(f"null {c}") for c in result.columns]
    stats += [F.min(q(c).cast("double")).alias(f"min {c}") for c in rates]
    stats += [F.max(q(c).cast("double")).alias(f"max {c}") for c in rates]
    stats += [
        F.count_if(q(c).isNull() | (F.round(q(c).cast("double"), 2) != q(c).cast("double"))).alias(
            f"fine {c}"
        )
        for c in rates
    ]
    stats += [F.count_if(q(c) < MIN_SAMPLE).alias(f"small {c}") for c in counts]
    stats += [
        F.count_if((q(c) >= MIN_SAMPLE) & (q(c) < INDICATIVE_SAMPLE)).alias(f"mid {c}")
        for c in counts
    ]
    stats += [F.count_if(q(c) == 0).alias(f"zero {c}") for c in counters]
    row = result.agg(*stats)
    n = F.col("rows")
    out = [F.when(n == 0, finding("empty_result", "", "error", n))]
    if numeric:
        nothing = F.lit(True)
        for c in numeric:
            nothing = nothing & (q(f"null {c}") == 1)
        for c in counters:
            nothing = nothing | (q(f"zero {c}") == 1)
        out.append(F.when((n == 1) & nothing, finding("no_match", "", "error", n)))
    for c in result.columns:
        nulls = q(f"null {c}")
        out.append(F.when(nulls > 0, finding("null_values", c, "warn", nulls)))
    for c in rates:
        lo, hi = q(f"min {c}"), q(f"max {c}")
        scaled = (hi > 1) & (hi <= 100)
        broken = ~scaled & ((hi > 100) | (lo < 0))
        out.append(F.when(scaled, finding("rate_scaled", c, "warn", hi)))
        worst = F.when(hi > 100, hi).otherwise(lo)
        out.append(F.when(broken, finding("rate_out_of_range", c, "error", worst)))
        coarse = (n > 0) & (q(f"fine {c}") == 0) & (lo >= 0) & (hi <= 1)
        out.append(F.when(coarse, finding("rate_too_coarse", c, "warn", n)))
    for c in counts:
        small, mid, many = q(f"small {c}"), q(f"mid {c}"), n > 1
        out.append(F.when(many & (small > 0), finding("small_groups", c, "insufficient", small)))
        out.append(
            F.when(many & (small == 0) & (mid > 0), finding("small_groups", c, "indicative", mid))
        )
    return emit(row, out)


def undefined_code_findings(
    view: DataFrame, codes: dict[str, list], expression: str | None = None
) -> DataFrame:
    """How many rows carry a code that the data dictionary does not define."""
    part = cohorts.cohort(view, expression)
    row = part.agg(*[F.count_if(undefined(c, ok)).alias(c) for c, ok in codes.items()])
    return emit(
        row, [F.when(F.col(c) > 0, finding("undefined_code", c, "warn", F.col(c))) for c in codes]
    )


def split_metric_findings(view: DataFrame) -> DataFrame:
    """AUC measured off the test split, with its lead over the test split."""
    gaps = monitor.split_gap(view).where("dataset <> 'test' AND gap_to_test IS NOT NULL")
    return gaps.select(
        F.lit("metric_off_test").alias("check_name"),
        F.col("dataset").alias("subject"),
        F.when(F.col("gap_to_test") > 0, "warn").otherwise("info").alias("severity"),
        F.col("gap_to_test").alias("value"),
    )


def simple_mean_findings(view: DataFrame, by: str, tolerance: float = 1e-4) -> DataFrame:
    """The mean of group rates where it departs from the weighted rate."""
    row = cohorts.weighted_vs_simple_rate(view, by)
    off = F.abs("gap") > tolerance
    return emit(row, [F.when(off, finding("mean_of_rates", by, "warn", F.col("gap")))])


def domain_findings(
    df: DataFrame, allowed: dict[str, list], patterns: dict[str, str] | None = None
) -> DataFrame:
    """Values outside their domain, with how often each occurs.

    Values are counted first; the domain is then a literal list of a few entries.
    """
    patterns = patterns or {}
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("seen"))
            for c in [*allowed, *patterns]
        ]
    )
    seen = (
        df.select(F.inline(cells)).groupBy("column_name", "seen").agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.lit(False)
    for c, values in allowed.items():
        known = known | (
            (F.col("column_name") == c) & F.col("seen").isin([str(v) for v in values])
        )
    for c, pattern in patterns.items():
        known = known | ((F.col("column_name") == c) & F.col("seen").rlike(pattern))
    return seen.where(F.col("seen").isNotNull() & ~known).select(
        F.lit("unknown_value").alias("check_name"),
        F.concat_ws("=", "column_name", "seen").alias("subject"),
        F.lit("error").alias("severity"),
        F.col("n").cast("double").alias("value"),
    )


def dimension_findings(requests: DataFrame, name: str = "name") -> DataFrame:
    """Requested dimensions that do not exist, with how often each is asked for."""
    asked = requests.groupBy(F.col(name).alias("subject")).agg(F.count(F.lit(1)).alias("value"))
    return asked.where(~F.coalesce(F.col("subject").isin(*DIMENSIONS), F.lit(False))).select(
        F.lit("unknown_dimension").alias("check_name"),
        "subject",
        F.lit("error").alias("severity"),
        F.col("value").cast("double").alias("value"),
    )


def groups_sum_findings(groups: DataFrame, n: str, total: DataFrame) -> DataFrame:
    """Group counts that do not add up to the total (a one-value frame)."""
    row = groups.agg(F.coalesce(F.sum(n), F.lit(0)).alias("s")).withColumn("t", total.scalar())
    off = F.col("s") != F.col("t")
    return emit(row, [F.when(off, finding("groups_sum", n, "error", F.col("s") - F.col("t")))])


def score_findings(view: DataFrame, score: str = "risk_score") -> DataFrame:
    """Missing scores, else scores outside [0, 1]."""
    s = F.col(score)
    row = view.agg(
        F.count_if(missing(view, score)).alias("missing"),
        F.count_if(~missing(view, score) & ((s < 0) | (s > 1))).alias("outside"),
    )
    lacking, beyond = F.col("missing"), F.col("outside")
    return emit(
        row,
        [
            F.when(lacking > 0, finding("score_missing", score, "error", lacking)),
            F.when(
                (lacking == 0) & (beyond > 0),
                finding("score_out_of_range", score, "error", beyond),
            ),
        ],
    )


def identity_findings(view: DataFrame, dim, target: str, base: str) -> DataFrame:
    """Effects that do not add up to the difference of the rates."""
    row = cohorts.compare_summary(view, dim, target, base).withColumn(
        "off", F.abs(F.col("mix_effect") + F.col("rate_effect") - F.col("diff"))
    )
    broken = F.col("off") > IDENTITY_TOLERANCE
    return emit(row, [F.when(broken, finding("identity", "diff", "error", F.col("off")))])


def additivity_findings(
    shap: DataFrame,
    view: DataFrame,
    target: str | None = None,
    tolerance: float = ADDITIVITY_TOLERANCE,
) -> DataFrame:
    row = attribution.additivity(shap, view, target)
    broken = F.col("gap") > tolerance
    return emit(row, [F.when(broken, finding("additivity", "log_odds", "error", F.col("gap")))])


def _size_checks(side: str) -> list[Column]:
    """An empty cohort, else one that is too small; over ``n_<side>``."""
    n = F.col(f"n_{side}")
    severity = sample_severity(n)
    return [
        F.when((n > 0) & severity.isNotNull(), finding("sample_size", side, severity, n)),
        F.when(n == 0, finding(f"empty_{side}", side, "error", n)),
    ]


def summary_findings(
    view: DataFrame, target: str | None, base: str | None = None, score: str = "risk_score"
) -> DataFrame:
    """Checks that accompany a score summary, in one scan; without ``base`` of the target alone."""
    t, b = cohorts.member(target), cohorts.member(base)
    lacking = missing(view, score)
    row = view.agg(
        F.count_if(t).alias("n_target"),
        F.count_if(b).alias("n_base"),
        F.count_if(t & lacking).alias("missing"),
        F.count_if(t & ~lacking & ((F.col(score) < 0) | (F.col(score) > 1))).alias("outside"),
    )
    checks = _size_checks("target") + (_size_checks("base") if base else [])
    none, beyond = F.col("missing"), F.col("outside")
    checks.append(F.when(none > 0, finding("score_missing", score, "error", none)))
    checks.append(
        F.when((none == 0) & (beyond > 0), finding("score_out_of_range", score, "error", beyond))
    )
    return emit(row, checks)


def performance_findings(
    view: DataFrame, expression: str | None = None, label: str = "is_bad"
) -> DataFrame:
    """Size of a cohort's test split, and whether it has both labels; one scan."""
    inside = cohorts.member(expression) & (F.col("dataset") == "test")
    row = view.agg(
        F.count_if(inside).alias("n_target"),
        F.count_if(inside & (F.col(label) == 1)).alias("pos"),
        F.count_if(inside & (F.col(label) != 1)).alias("neg"),
    )
    one = (F.col("n_target") > 0) & ((F.col("pos") == 0) | (F.col("neg") == 0))
    single = F.when(one, finding("single_label", label, "error", F.col("n_target")))
    return emit(row, [*_size_checks("target"), single])


def quality_findings(
    view: DataFrame, expression: str | None = None, codes: dict[str, list] | None = None
) -> DataFrame:
    """Size of a cohort and values outside the defined codes; one scan."""
    from shiftlens.catalog import EDUCATION_CODES, MARRIAGE_CODES

    known = codes or {"education": EDUCATION_CODES, "marriage": MARRIAGE_CODES}
    inside = cohorts.member(expression)
    row = view.agg(
        F.count_if(inside).alias("n_target"),
        *[F.count_if(inside & undefined(c, values)).alias(f"off_{c}") for c, values in known.items()],
    )
    off = [
        F.when(F.col(f"off_{c}") > 0, finding("undefined_code", c, "warn", F.col(f"off_{c}")))
        for c in known
    ]
    return emit(row, [*_size_checks("target"), *off])


def attribution_findings(
    shap: DataFrame,
    view: DataFrame,
    target: str | None,
    base: str | None = None,
    tolerance: float = ADDITIVITY_TOLERANCE,
) -> DataFrame:
    """Sizes of both cohorts, and whether their attributions add up to their mean log-odds."""
    sums = shap.groupBy("user_id").agg(F.sum("shap_value").alias("total"))
    users = view.select(
        "user_id",
        logit(F.col("risk_score")).alias("odds"),
        cohorts.member(target).alias("target"),
        cohorts.member(base).alias("base"),
    ).join(sums, "user_id", "left")
    rest = F.col("odds") - F.col("total")
    sides = ["target", "base"] if base else ["target"]
    row = users.agg(
        F.avg(rest).alias("constant"),
        *[F.count_if(F.col(s)).alias(f"n_{s}") for s in sides],
        *[F.avg(F.when(F.col(s), F.col("odds"))).alias(f"odds_{s}") for s in sides],
        *[F.avg(F.when(F.col(s), F.col("total"))).alias(f"total_{s}") for s in sides],
    )
    checks = []
    for s in sides:
        gap = F.abs(F.col(f"odds_{s}") - F.col("constant") - F.col(f"total_{s}"))
        checks += _size_checks(s)
        checks.append(F.when(gap > tolerance, finding("additivity", s, "error", gap)))
    return emit(row, checks)


def compare_findings(
    view: DataFrame, dim: str, target: str, base: str | None, codes: dict[str, list] | None = None
) -> DataFrame:
    """All checks that accompany a two-cohort comparison; without ``base`` those of the target alone."""
    from shiftlens.catalog import EDUCATION_CODES, MARRIAGE_CODES

    known = codes or {"education": EDUCATION_CODES, "marriage": MARRIAGE_CODES}
    sizes = view.select(
        cohorts.compared(base).alias("b"), cohorts.member(target).alias("t")
    ).agg(F.count_if("b").alias("n_base"), F.count_if("t").alias("n_target"))
    out = emit(sizes, _size_checks("target") + (_size_checks("base") if base else []))
    segments = cohorts.segment_profile(view, dim, target).select("segment", "n")
    out = out.unionByName(result_findings(segments))
    if dim in known:
        out = out.unionByName(undefined_code_findings(view, {dim: known[dim]}, target))
    return out.unionByName(identity_findings(view, dim, target, base))
