"""Queries over what is stored between runs: sketches, laid-out tables and followed folders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftlens.catalog import BILL_COLUMNS, LOANS_SCHEMA, LOAN_COLUMNS, PAYMENT_COLUMNS, RAW_HEADINGS, STATUS_COLUMNS
from shiftlens.operators import cohort as C, monitor as M, sketches as K
from shiftlens.plans.answer_queries import _answers_sql, answers
from shiftlens.plans.binding import OBS_SQL, loans, observations as obs, scores, table
from shiftlens.plans.cohort_queries import EARLY, LATE
from shiftlens.plans.registry import add
from shiftlens.session import shared_folder
from shiftlens.sources.layout import write_laid_out
from shiftlens.sources.tables import (
    QUESTION_SCHEMA,
    RUN_SCHEMA,
    UNREADABLE,
    read_checked_json,
    read_sheet,
    stored,
    unreadable_findings,
)
from shiftlens.streaming import monitor as S

PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _text(condition: Column) -> Column:
    return condition.cast("string")


def _sketch_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Deciles of each channel from its months' sketches, held against the exact ranks."""
    view = obs(spark, folder)
    rows = stored(K.sketched(view, ["channel", "loan_month"], "p"))
    found = K.score_quantiles(rows, PROBS, ["channel"])
    probs = F.array(*[F.lit(p) for p in PROBS])
    each = found.select("channel", "n", F.posexplode("quantiles").alias("i", "q")).withColumn(
        "prob", F.element_at(probs, F.col("i") + 1)
    )
    # the rank of a value lies between the share below it and the share up to it
    ranked = (
        each.join(view.select("channel", "p"), "channel")
        .groupBy("channel", "n", "prob", "q")
        .agg(
            F.avg((F.col("p") < F.col("q")).cast("int")).alias("below"),
            F.avg((F.col("p") <= F.col("q")).cast("int")).alias("upto"),
        )
    )
    inside = (F.col("below") - K.RANK_BOUND <= F.col("prob")) & (
        F.col("prob") <= F.col("upto") + K.RANK_BOUND
    )
    return ranked.select("channel", "prob", "n", _text(inside).alias("within_bound"))


def _sketch_psi(spark: SparkSession, folder: str) -> DataFrame:
    """The shift between two ranges of months from stored sketches, beside the exact one."""
    view = obs(spark, folder)
    rows = stored(K.sketched(view, ["loan_month"], "p"))
    found = K.psi(rows, F.expr(LATE), F.expr(EARLY)).select(F.col("psi").alias("sketched"), "shift")
    exact = M.psi(view, LATE, EARLY, score="p").select("psi")
    # ten bins, each share off by two ranks
    near = F.abs(F.col("sketched") - F.col("psi")) <= 10 * 2 * K.RANK_BOUND
    return exact.join(F.broadcast(found), F.lit(True)).select("psi", "shift", _text(near).alias("near"))


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one segment's early and late months, in common and apart, from stored sketches."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("loan_month"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("risk_score"),
    )
    rows = stored(K.sketched(orders, ["loan_month", "priority"]))
    urgent, late = F.col("priority") == "1-URGENT", F.expr(LATE)
    found = K.overlap(rows, urgent, late)
    users = orders.groupBy("user_id").agg(F.max(urgent).alias("l"), F.max(late).alias("r"))
    exact = users.agg(
        F.count_if("l").alias("l"),
        F.count_if("r").alias("r"),
        F.count_if(F.col("l") & F.col("r")).alias("both"),
        F.count_if(F.col("l") | F.col("r")).alias("either"),
        F.count_if(F.col("l") & ~F.col("r")).alias("alone"),
    )
    room = K.SET_BOUND * F.col("either")
    pairs = (("n_left", "l"), ("n_right", "r"), ("n_both", "both"), ("n_either", "either"), ("n_left_only", "alone"))
    return exact.join(F.broadcast(found), F.lit(True)).select(
        *[F.col(b).alias(a) for a, b in pairs],
        *[_text(F.abs(F.col(a) - F.col(b)) <= room).alias(f"{a}_near") for a, b in pairs],
    )


def laid_out_view(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    # few buckets, as every month has a file for each
    facts = write_laid_out(loans(spark, folder), f"{path}/loans", month="loan_month", buckets=4)
    rated = write_laid_out(scores(spark, folder), f"{path}/scores", buckets=4)
    return C.base_view(spark.table(facts), spark.table(rated))


def _followed(spark: SparkSession, folder: str) -> DataFrame:
    """Events arrive in four parts; the query stops between them, and the first day comes again at the end."""
    path = shared_folder(spark)
    # instants that read as the written times in UTC, whatever the session's zone
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts)")
    written = spark.read.parquet(f"{folder}/events.parquet").select(at.alias("at"), "event_type", "value")
    events = stored(written.withColumn("ts", F.timestamp_micros("at")))
    low, high = events.agg(F.min("at"), F.max("at")).first()
    part = F.least(F.floor((F.col("at") - low) * 4 / F.lit(max(1, high - low))), F.lit(3))

    def run() -> int:
        stream = S.read_stream(spark, f"{path}/in", events.schema)
        windows = S.windowed(stream, ["event_type"], aggregates={"total": F.sum("value")})
        query = S.follow(windows, f"{path}/out", f"{path}/checkpoint")
        query.awaitTermination()
        return S.late_rows(query)

    late = 0
    day = 86_400_000_000
    first_day = F.floor(F.col("at") / day) == low // day
    for arrived in (*(part == i for i in range(4)), first_day):
        events.where(arrived).write.mode("append").parquet(f"{path}/in")
        late += run()
    epoch = F.expr("date_add(DATE '1970-01-01', CAST(floor(unix_seconds(start) / 86400) AS INT))")
    return S.current(spark, f"{path}/out", ["event_type"]).select(
        epoch.cast("string").alias("day"),
        "event_type",
        "n",
        (F.col("total") / F.col("n")).alias("mean_value"),
        F.lit(late > 0).cast("string").alias("late_rows_seen"),
    )


def _sheet(spark: SparkSession, folder: str) -> DataFrame:
    """The facts as a raw sheet, with group names above the headings of each file and some broken lines."""
    headings = {name: raw for raw, name in RAW_HEADINGS.items()}
    names = [c for c in LOAN_COLUMNS if c in headings]
    heads = [",".join(f"X{i}" for i in range(len(names))), ",".join(headings[c] for c in names)]
    values = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    broken = F.when(F.col("user_id") % 50 == 0, F.array(values, F.concat(F.lit("total "), values)))
    lines = loans(spark, folder).select(F.explode(F.coalesce(broken, F.array(values))).alias("value"))

    def headed(batches):
        yield pd.DataFrame({"value": heads})
        yield from batches

    path = shared_folder(spark)
    lines.mapInPandas(headed, "value string").write.text(path)
    return read_sheet(spark, path, LOANS_SCHEMA)


def _written(lines: DataFrame, spark: SparkSession) -> str:
    path = shared_folder(spark)
    lines.write.text(path)
    return path


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Nested run records as JSON lines, of which some are cut off."""
    record = F.to_json(
        F.struct(
            "id",
            "category",
            "status",
            F.struct(
                (F.col("status") == "ok").alias("passed"),
                F.transform(
                    "checks",
                    lambda c: F.struct(c["type"].alias("type"), (F.col("status") == "ok").alias("passed")),
                ).alias("checks"),
            ).alias("grade"),
            "steps",
        )
    )
    cut = F.when(F.substring("id", -1, 1) == "7", F.substring(record, F.lit(1), F.length(record) - 5))
    lines = answers(spark, folder).select(F.coalesce(cut, record).alias("value"))
    return read_checked_json(spark, _written(lines, spark), RUN_SCHEMA)


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Nested questions as JSON lines."""
    kept = F.transform(
        "checks", lambda c: F.struct(*[c[f].alias(f) for f in ("type", "value", "kind", "any")])
    )
    lines = answers(spark, folder).select(
        F.to_json(F.struct("id", "category", "question", kept.alias("checks"))).alias("value")
    )
    return read_checked_json(spark, _written(lines, spark), QUESTION_SCHEMA)


def _unreadable(spark: SparkSession, folder: str) -> DataFrame:
    return unreadable_findings(_sheet(spark, folder), "sheet").unionByName(
        unreadable_findings(_runs(spark, folder), "runs")
    )


def register() -> None:
    values = ", ".join(f"({p})" for p in PROBS)
    add(
        "sketch_quantiles",
        "A13",
        "channel, prob:2, n:i, within_bound",
        _sketch_quantiles,
        f"""SELECT channel, prob, count(*) AS n, 'true' AS within_bound
        FROM v, (VALUES {values}) p(prob) GROUP BY 1, 2""",
    )
    from shiftlens.plans.score_queries import PSI_SELECT, _bins_sql

    add(
        "sketch_psi",
        "O6 A13",
        "psi:6, shift, near",
        _sketch_psi,
        f"SELECT *, 'true' AS near FROM ({PSI_SELECT})",
        (OBS_SQL, _bins_sql("p", EARLY, LATE)),
    )
    late = LATE.replace("loan_month", "strftime(o_orderdate, '%Y-%m')")
    add(
        "cohort_overlaps",
        "A4 O22",
        "n_left:i, n_right:i, n_both:i, n_either:i, n_left_only:i, n_left_near, n_right_near,"
        " n_both_near, n_either_near, n_left_only_near",
        _overlaps,
        f"""SELECT count(*) FILTER (l) AS n_left, count(*) FILTER (r) AS n_right,
          count(*) FILTER (l AND r) AS n_both, count(*) FILTER (l OR r) AS n_either,
          count(*) FILTER (l AND NOT r) AS n_left_only, 'true' AS n_left_near, 'true' AS n_right_near,
          'true' AS n_both_near, 'true' AS n_either_near, 'true' AS n_left_only_near
        FROM (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS l, bool_or({late}) AS r
          FROM orders GROUP BY 1)""",
        (),
    )
    add(
        "laid_out_view_join",
        "S2 S3 P2 J1",
        "dataset, risk_level, n:i, avg_score:6, bad_rate:6",
        lambda s, d: laid_out_view(s, d)
        .where(LATE)
        .groupBy("dataset", "risk_level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("risk_score").alias("avg_score"),
            F.avg("is_bad").alias("bad_rate"),
        ),
        f"""SELECT dataset, risk_level, count(*) AS n, avg(risk_score) AS avg_score,
          avg(is_bad) AS bad_rate FROM v WHERE {LATE} GROUP BY 1, 2""",
    )
    raw = [c for c in LOAN_COLUMNS if c in set(RAW_HEADINGS.values())]
    money = {"credit_limit", *BILL_COLUMNS, *PAYMENT_COLUMNS}
    add(
        "raw_sheet",
        "S1",
        ", ".join(f"{c}:2" if c in money else f"{c}:0" if c in STATUS_COLUMNS else f"{c}:i" for c in raw),
        lambda s, d: _sheet(s, d).where(F.col(UNREADABLE).isNull()),
        "SELECT * FROM v",
    )
    nested = (OBS_SQL, _answers_sql())
    add(
        "nested_runs",
        "S8 G14",
        "id, n_steps:i, n_errors:i, passed, n_checks:i",
        lambda s, d: _runs(s, d)
        .where(F.col(UNREADABLE).isNull())
        .select(
            "id",
            F.size("steps").alias("n_steps"),
            F.size(F.filter("steps", lambda x: x["is_error"])).alias("n_errors"),
            F.col("grade.passed").cast("string").alias("passed"),
            F.size("grade.checks").alias("n_checks"),
        ),
        """SELECT 'Q' || user_id AS id, n_tool_calls AS n_steps, n_tool_errors AS n_errors,
          CAST(status = 'ok' AS VARCHAR) AS passed, 5 AS n_checks FROM rec WHERE user_id % 10 <> 7""",
        nested,
    )
    add(
        "nested_questions",
        "S8",
        "type, kind, n:i, n_values:i, n_any:i",
        lambda s, d: _questions(s, d)
        .select(F.inline("checks"))
        .groupBy("type", F.coalesce("kind", F.lit("")).alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("value").alias("n_values"),
            F.sum(F.coalesce(F.size("any"), F.lit(0))).alias("n_any"),
        ),
        """SELECT type, kind, count(*) AS n, count(*) FILTER (type = 'number') AS n_values,
          sum(CASE WHEN type = 'contains' THEN 2 ELSE 0 END) AS n_any
        FROM v, (VALUES ('number', 'score'), ('number', 'rate'), ('number', 'abs'), ('contains', ''),
          ('judge', '')) c(type, kind) GROUP BY 1, 2""",
    )
    add(
        "unreadable_lines",
        "S1 S8",
        "check_name, subject, severity, value:0",
        _unreadable,
        """SELECT 'unreadable_lines' AS check_name, subject, 'error' AS severity, value FROM (
          SELECT 'sheet' AS subject, count(*) FILTER (user_id % 50 = 0) AS value FROM v
          UNION ALL SELECT 'runs', count(*) FILTER (user_id % 10 = 7) FROM v)""",
    )
    add(
        "followed_events",
        "A7",
        "day, event_type, n:i, mean_value:6, late_rows_seen",
        _followed,
        """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, avg(value) AS mean_value,
          'true' AS late_rows_seen FROM events GROUP BY 1, 2""",
        (),
    )
