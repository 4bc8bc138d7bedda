"""Score monitoring, attribution and batch scoring."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, functions as F

from shiftlens.catalog import CHANNELS, CITY_TIERS, FEATURES, MONTHS
from shiftlens.functions.numeric import logit, uniform_draw
from shiftlens.operators import (
    assignment,
    attribution as A,
    boosting as B,
    cohort as C,
    monitor as M,
    scoring as S,
)
from shiftlens.operators.ordering import exact_quantiles
from shiftlens.plans.binding import OBS_SQL, SHAP_SQL, attributions, loans, observations as obs
from shiftlens.plans.cohort_queries import EARLY, LATE, S1_B, S1_T
from shiftlens.plans.registry import add
from shiftlens.plans.sqltext import auc_sql, draw_sql
from shiftlens.sources.tables import stored

GRID = [i / 10 for i in range(11)]
AUC_SPEC = "n:i, auc:6, ks:6"


def _bins_sql(score: str, base: str, target: str) -> str:
    """CTEs ``edges`` and ``bins`` of the stability index."""
    return f"""q AS (SELECT quantile_cont({score}, {GRID}) AS qs FROM v WHERE {base}),
      lohi AS (SELECT list_min(qs) AS lo, list_max(qs) AS hi, qs FROM q),
      edges AS (SELECT list_distinct(list_filter(qs, lambda e: e > lo AND e < hi)) AS es FROM lohi),
      placed AS (SELECT len(list_filter(es, lambda e: e <= {score})) AS bin,
        coalesce({base}, FALSE) AS b, coalesce({target}, FALSE) AS t FROM v, edges),
      bins AS (SELECT k.bin, count(*) FILTER (b) AS n_base, count(*) FILTER (t) AS n_target
        FROM (SELECT unnest(range(len(es)+1)) AS bin FROM edges) k
        LEFT JOIN placed p ON p.bin = k.bin GROUP BY 1)"""


PSI_SELECT = """SELECT psi, CASE WHEN psi < 0.1 THEN '稳定' WHEN psi < 0.25 THEN '轻微偏移'
    ELSE '显著偏移' END AS shift
  FROM (SELECT sum((t-b)*ln(t/b)) AS psi FROM (SELECT
    greatest(n_base/CAST(sum(n_base) OVER () AS DOUBLE), 1e-6) AS b,
    greatest(n_target/CAST(sum(n_target) OVER () AS DOUBLE), 1e-6) AS t FROM bins))"""


def _planted(spark, folder) -> DataFrame:
    return assignment.assign_business_fields(obs(spark, folder))


def _choice_sql(values: list[str], weights: list[str], u: str) -> str:
    total = "(" + "+".join(weights) + ")"
    out, seen = "CASE", []
    for value, w in zip(values[:-1], weights[:-1]):
        seen.append(w)
        out += f" WHEN {u}*{total} < {'+'.join(seen)} THEN '{value}'"
    return out + f" ELSE '{values[-1]}' END"


def _planted_sql() -> str:
    young = "(age<=30 AND credit_limit<=50000)"
    u1, u2, u3 = (draw_sql("user_id", s) for s in (1, 2, 3))
    rows = {
        "age>=45": ["0.3", "0.1", "0.2", "0.4"],
        young: ["0.25", "0.45", "0.2", "0.1"],
        "TRUE": ["0.35", "0.25", "0.2", "0.2"],
    }
    channel = (
        "CASE"
        + "".join(
            f" WHEN {cond} THEN {_choice_sql(CHANNELS, w, u1)}" for cond, w in rows.items()
        )
        + " END"
    )
    weights = []
    for m in range(1, 13):
        if m >= 10:
            w = (
                f"(CASE WHEN channel='{CHANNELS[1]}' AND {young} THEN 12.0"
                f" WHEN channel='{CHANNELS[1]}' THEN 0.3 ELSE 1.0 END)"
            )
        elif m == 6:
            w = f"(CASE WHEN channel='{CHANNELS[2]}' AND pay_status_1>=1 THEN 8.0 ELSE 1.0 END)"
        else:
            w = "1.0"
        weights.append(w)
    return f"""drawn AS (SELECT * REPLACE ({channel} AS channel) FROM v),
      planted AS (SELECT * REPLACE ({_choice_sql(MONTHS, weights, u2)} AS loan_month,
        {_choice_sql(CITY_TIERS, ["0.3", "0.4", "0.3"], u3)} AS city_tier) FROM drawn)"""


def _split_sql() -> str:
    return f"""u AS (SELECT *, {draw_sql("user_id", 11)} AS u FROM v),
      r AS (SELECT *, row_number() OVER (PARTITION BY is_bad ORDER BY u, user_id) AS rk FROM u),
      c1 AS (SELECT is_bad AS lab, count(*) AS n FROM v GROUP BY 1),
      c2 AS (SELECT *, ceil(sum(n) OVER () * 0.2) AS want, sum(n) OVER () AS tot FROM c1),
      c3 AS (SELECT *, want*n/tot AS ex, floor(want*n/tot) AS fl FROM c2),
      c4 AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY ex-fl DESC, lab)
        <= want - sum(fl) OVER () THEN 1 ELSE 0 END AS n_test FROM c3),
      d2 AS (SELECT lab, n_test, n-n_test AS rest, ceil(sum(n-n_test) OVER () * 0.2) AS want,
        sum(n-n_test) OVER () AS tot FROM c4),
      d3 AS (SELECT *, want*rest/tot AS ex, floor(want*rest/tot) AS fl FROM d2),
      d4 AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY ex-fl DESC, lab)
        <= want - sum(fl) OVER () THEN 1 ELSE 0 END AS n_valid FROM d3),
      sp AS (SELECT user_id, is_bad, CASE WHEN rk <= n_test THEN 'test'
        WHEN rk <= n_test+n_valid THEN 'valid' ELSE 'train' END AS dataset
        FROM r JOIN d4 ON is_bad = lab)"""


STORED = M.STORED_DECIMALS  # of risk_score


def _boosted(spark, folder) -> tuple:
    features = S.build_features(loans(spark, folder), "user_id", "is_bad")
    rows = stored(S.stratified_split(features))
    return B.train(rows), rows


def _boosted_metrics(spark, folder) -> DataFrame:
    """Split sizes, what one feature alone tells, and what must hold of the record."""
    model, rows = _boosted(spark, folder)
    scored = stored(B.score(model, rows))
    other = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="is_bad", metricName="areaUnderROC", numBins=0
    ).evaluate(scored.where("dataset = 'test'").withColumn("is_bad", F.col("is_bad").cast("double")))
    best = len(model.trees) - 1
    patience, history = model.settings.patience, model.history
    # no later tree is better, and growing ended when patience did
    ended = len(history) == model.settings.max_trees or len(history) == best + 1 + patience
    chosen = max(history) == history[best] and ended
    record = S.metrics_record(scored, best, len(FEATURES))
    status = M.auc_ks(rows.where("dataset = 'train'"), score="max_pay_status")
    single = status.select(F.col("auc").alias("status_auc"))
    return record.join(F.broadcast(single), F.lit(True)).select(
        "n_features",
        "n_train",
        "n_valid",
        "n_test",
        "status_auc",
        F.lit(patience).alias("patience"),
        (F.abs(F.col("test_auc") - other) <= 0.5e-4 + 1e-9).cast("string").alias("auc_agrees"),
        (F.lit(chosen) & (F.col("best_iteration") == best)).cast("string").alias("best_iteration_holds"),
        (F.col("train_auc") > F.col("status_auc")).cast("string").alias("beats_status"),
    )


def _boosted_gap(spark, folder) -> DataFrame:
    """How far tree attributions are from adding up to the log-odds, over all rows."""
    model, rows = _boosted(spark, folder)
    wide = B.tree_attributions(model, rows)
    total = sum((F.col(f"`{c}`") for c in FEATURES), F.lit(0.0))
    sums = wide.select("user_id", total.alias("total"))
    odds = B.score(model, rows).select("user_id", logit(F.col("score")).alias("odds"))
    gap = F.col("odds") - F.col("total")
    return odds.join(sums, "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(gap) - F.min(gap), 6).alias("spread")
    )


def register() -> None:
    view_shap = (OBS_SQL, SHAP_SQL)
    levels = """count(*) AS n, avg(risk_score) AS avg_score, avg(is_bad) AS bad_rate,
      avg(CAST(risk_level='高' AS INT)) AS high_share,
      avg(CAST(risk_level='中' AS INT)) AS mid_share,
      avg(CAST(risk_level='低' AS INT)) AS low_share"""
    add(
        "score_summary",
        "O5 U1 A16",
        "ord:i, cohort, n:i, avg_score:6, bad_rate:6, high_share:6, mid_share:6, low_share:6",
        lambda s, d: M.score_summary(obs(s, d), S1_T, S1_B),
        f"""SELECT 0 AS ord, 'base' AS cohort, {levels} FROM v WHERE {S1_B}
        UNION ALL SELECT 1, 'target', {levels} FROM v WHERE {S1_T}""",
    )
    for name, score, t, b, full in (
        ("late", "risk_score", LATE, EARLY, 4),
        ("segment", "risk_score", S1_T, S1_B, 4),
        ("unrounded", "p", LATE, EARLY, None),
    ):
        ctes = (OBS_SQL, _bins_sql(score, b, t))
        add(
            f"score_bins_{name}",
            "A14 U3",
            "bin:i, n_base:i, n_target:i",
            lambda s, d, t=t, b=b, score=score, full=full: M.score_bins(
                obs(s, d), t, b, score=score, decimals=full
            ),
            "SELECT * FROM bins",
            ctes,
        )
        add(
            f"psi_{name}",
            "O6 A13",
            "psi:6, shift",
            lambda s, d, t=t, b=b, score=score, full=full: M.psi(
                obs(s, d), t, b, score=score, decimals=full
            ),
            PSI_SELECT,
            ctes,
        )
    add(
        "psi_of_itself",
        "O6",
        "psi:6, shift",
        lambda s, d: M.psi(obs(s, d), "TRUE", "TRUE"),
        "SELECT 0.0 AS psi, '稳定' AS shift FROM v LIMIT 1",
    )
    add(
        "psi_alone",
        "O6",
        "psi:6, shift",
        lambda s, d: M.psi(obs(s, d), LATE, None),
        "SELECT CAST(NULL AS DOUBLE) AS psi, CAST(NULL AS VARCHAR) AS shift FROM v LIMIT 1",
    )
    add(
        "score_quantiles",
        "A13",
        "q10:6, q50:6, q90:6",
        lambda s, d: exact_quantiles(
            obs(s, d).groupBy("p").agg(F.count(F.lit(1)).alias("n")), "p", "n", [0.1, 0.5, 0.9]
        ).select(*[F.col("quantiles")[i].alias(f"q{q}") for i, q in enumerate((10, 50, 90))]),
        """SELECT quantile_cont(p, 0.1) AS q10, quantile_cont(p, 0.5) AS q50,
          quantile_cont(p, 0.9) AS q90 FROM v""",
    )
    add(
        "score_histogram",
        "A14",
        "bin:i, lo:2, hi:2, n:i",
        lambda s, d: M.histogram(obs(s, d), "risk_score", [0, 0.1, 0.2, 0.3, 0.4, 0.5, 1]),
        """SELECT b.bin, b.lo, b.hi, count(v.user_id) AS n FROM (VALUES (0, 0.0, 0.1), (1, 0.1, 0.2),
          (2, 0.2, 0.3), (3, 0.3, 0.4), (4, 0.4, 0.5), (5, 0.5, 1.0)) b(bin, lo, hi)
        LEFT JOIN v ON risk_score >= CAST(lo AS DOUBLE)
          AND (risk_score < CAST(hi AS DOUBLE) OR (bin = 5 AND risk_score = 1)) GROUP BY ALL""",
    )
    add(
        "auc_ks_test_split",
        "O7 O8 W4 A12",
        AUC_SPEC,
        lambda s, d: M.auc_ks(obs(s, d).where("dataset = 'test'")),
        auc_sql("(SELECT * FROM v WHERE dataset='test')"),
    )
    add(
        "auc_ks_unrounded",
        "O7 O8 W4",
        "dataset, " + AUC_SPEC,
        lambda s, d: M.auc_ks(obs(s, d), ["dataset"], score="p"),
        auc_sql("v", "p", "dataset"),
    )
    add(
        "roc_points",
        "W4",
        "score:4, pos:i, neg:i, tpr:6, fpr:6",
        lambda s, d: M.roc_points(obs(s, d).where("dataset = 'test'")),
        """SELECT s AS score, pos, neg, sum(pos) OVER w/CAST(sum(pos) OVER () AS DOUBLE) AS tpr,
          sum(neg) OVER w/CAST(sum(neg) OVER () AS DOUBLE) AS fpr
        FROM (SELECT risk_score AS s, sum(is_bad) AS pos, sum(1-is_bad) AS neg FROM v
          WHERE dataset='test' GROUP BY 1)
        WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)""",
    )
    for name, expr in (("", "TRUE"), ("_one_channel", "channel = 'MACHINERY'")):
        add(
            f"performance{name}",
            "O9",
            "n:i, bad_rate:6, avg_score:6, auc:6, ks:6",
            lambda s, d, expr=expr: M.performance(obs(s, d), expr, STORED),
            f"""SELECT a.*, b.bad_rate, b.avg_score FROM
              ({auc_sql(f"(SELECT * FROM v WHERE dataset='test' AND ({expr}))")}) a,
              (SELECT avg(is_bad) AS bad_rate, avg(risk_score) AS avg_score FROM v
                WHERE dataset='test' AND ({expr})) b""",
        )
    by_channel = auc_sql("(SELECT * FROM v WHERE dataset='test')", by="channel")
    add(
        "grouped_auc_channel",
        "O10",
        "channel, " + AUC_SPEC,
        lambda s, d: M.grouped_auc(obs(s, d), "channel", STORED),
        by_channel,
    )
    add(
        "weakest_channel",
        "O10 L7",
        "channel, auc:6",
        lambda s, d: M.weakest_group(obs(s, d), "channel"),
        f"SELECT channel, auc FROM ({by_channel}) ORDER BY auc, channel LIMIT 1",
    )
    add(
        "split_gap",
        "Q9",
        "dataset, n:i, auc:6, ks:6, gap_to_test:6",
        lambda s, d: M.split_gap(obs(s, d)),
        f"""SELECT *, auc - max(CASE WHEN dataset='test' THEN auc END) OVER () AS gap_to_test
        FROM ({auc_sql("v", by="dataset")})""",
    )
    add(
        "calibration",
        "O19",
        "n:i, avg_score:6, bad_rate:6, gap:6",
        lambda s, d: M.calibration(obs(s, d)),
        """SELECT count(*) AS n, avg(risk_score) AS avg_score, avg(is_bad) AS bad_rate,
          avg(risk_score)-avg(is_bad) AS gap FROM v""",
    )
    add(
        "calibration_by_level",
        "O19",
        "risk_level, n:i, avg_score:6, bad_rate:6, gap:6",
        lambda s, d: M.calibration(obs(s, d), "risk_level"),
        """SELECT risk_level, count(*) AS n, avg(risk_score) AS avg_score,
          avg(is_bad) AS bad_rate, avg(risk_score)-avg(is_bad) AS gap FROM v GROUP BY 1""",
    )
    add(
        "risk_level_counts",
        "P18",
        "risk_level, n:i, lowest:4, highest:4",
        lambda s, d: obs(s, d)
        .groupBy(M.risk_level(F.col("p")).alias("risk_level"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("p").alias("lowest"), F.max("p").alias("highest")
        ),
        """SELECT risk_level, count(*) AS n, min(p) AS lowest, max(p) AS highest
        FROM v GROUP BY 1""",
    )
    add(
        "score_log_odds",
        "P22",
        "channel, mean_log_odds:6, lowest:6, highest:6",
        lambda s, d: obs(s, d)
        .groupBy("channel")
        .agg(
            F.avg(logit(F.col("risk_score"))).alias("mean_log_odds"),
            F.min(logit(F.col("risk_score"))).alias("lowest"),
            F.max(logit(F.col("risk_score"))).alias("highest"),
        ),
        """SELECT channel, avg(l) AS mean_log_odds, min(l) AS lowest, max(l) AS highest
        FROM (SELECT channel, ln(c/(1-c)) AS l FROM (SELECT channel,
          least(greatest(risk_score, 1e-6), 1-1e-6) AS c FROM v)) GROUP BY 1""",
    )

    add(
        "attributions_long",
        "P23 M9",
        "user_id:i, feature, shap_value:6",
        lambda s, d: attributions(obs(s, d)),
        "SELECT * FROM shap",
        view_shap,
    )
    for name, cond in (("", "TRUE"), ("_segment", S1_T)):
        add(
            f"importance{name}",
            "O11 J2 A4 A5 L2",
            "feature, mean_abs_shap:6, mean_shap:6, n_users:i",
            lambda s, d, cond=cond: A.importance(attributions(obs(s, d)), obs(s, d), cond, 2),
            f"""SELECT feature, avg(abs(shap_value)) AS mean_abs_shap, avg(shap_value) AS mean_shap,
              count(DISTINCT user_id) AS n_users FROM shap JOIN v USING (user_id) WHERE {cond}
            GROUP BY 1 ORDER BY 2 DESC LIMIT 2""",
            view_shap,
        )
    add(
        "global_importance",
        "M11 A17",
        "feature, mean_abs_shap:6",
        lambda s, d: A.global_importance(attributions(obs(s, d))),
        "SELECT feature, avg(abs(shap_value)) AS mean_abs_shap FROM shap GROUP BY 1",
        view_shap,
    )
    add(
        "attribution_compare",
        "O12 J4 L3",
        "feature, n_base:i, n_target:i, mean_shap_base:6, mean_shap_target:6, diff:6, total_diff:6,"
        " share_of_total:4",
        lambda s, d: A.compare(attributions(obs(s, d)), obs(s, d), S1_T, S1_B, 2),
        f"""SELECT *, sum(diff) OVER () AS total_diff, diff/sum(diff) OVER () AS share_of_total
          FROM (SELECT feature, count(DISTINCT user_id) FILTER ({S1_B}) AS n_base,
            count(DISTINCT user_id) FILTER ({S1_T}) AS n_target,
            avg(shap_value) FILTER ({S1_B}) AS mean_shap_base,
            avg(shap_value) FILTER ({S1_T}) AS mean_shap_target,
            avg(shap_value) FILTER ({S1_T})-avg(shap_value) FILTER ({S1_B}) AS diff
          FROM shap JOIN v USING (user_id) GROUP BY 1)
        ORDER BY diff DESC LIMIT 2""",
        view_shap,
    )
    add(
        "attribution_alone",
        "O12 L2",
        "feature, mean_abs_shap:6, mean_shap:6, n_users:i",
        lambda s, d: A.compare(attributions(obs(s, d)), obs(s, d), S1_T, None, 2),
        f"""SELECT feature, avg(abs(shap_value)) AS mean_abs_shap, avg(shap_value) AS mean_shap,
          count(DISTINCT user_id) AS n_users FROM shap JOIN v USING (user_id) WHERE {S1_T} GROUP BY 1
        ORDER BY mean_abs_shap DESC, feature LIMIT 2""",
        view_shap,
    )
    sums = "(SELECT user_id, sum(shap_value) AS s FROM shap GROUP BY 1)"
    odds = "ln(risk_score/(1-risk_score))"
    add(
        "attribution_base_value",
        "O13 J5",
        "base_value:6",
        lambda s, d: A.base_value(attributions(obs(s, d)), obs(s, d)),
        f"SELECT avg({odds}-s) AS base_value FROM v JOIN {sums} USING (user_id)",
        view_shap,
    )
    add(
        "attribution_additivity",
        "O14",
        "n:i, mean_log_odds:6, mean_shap_sum:6, base_value:6, gap:6",
        lambda s, d: A.additivity(attributions(obs(s, d)), obs(s, d), S1_T),
        f"""SELECT n, mean_log_odds, mean_shap_sum, base_value,
          abs(mean_log_odds-base_value-mean_shap_sum) AS gap
        FROM (SELECT count(*) FILTER ({S1_T}) AS n, avg({odds}) FILTER ({S1_T}) AS mean_log_odds,
          avg(s) FILTER ({S1_T}) AS mean_shap_sum, avg({odds}-s) AS base_value
          FROM v JOIN {sums} USING (user_id))""",
        view_shap,
    )
    add(
        "entity_reasons",
        "O20 W3",
        "user_id:i, risk_score:4, reason_rank:i, feature, shap_value:6",
        lambda s, d: A.entity_reasons(attributions(obs(s, d)), obs(s, d), 2, LATE),
        f"""SELECT user_id, risk_score, reason_rank, feature, shap_value FROM (SELECT *,
          row_number() OVER (PARTITION BY user_id ORDER BY shap_value DESC, feature) AS reason_rank
          FROM shap) JOIN v USING (user_id) WHERE reason_rank <= 2 AND {LATE}""",
        view_shap,
    )

    add(
        "derived_features",
        "M5 P14 P15 P16 P17",
        "user_id:i, utilization_1:6, max_pay_status:i, n_overdue_months:i, repay_ratio_1:6",
        lambda s, d: S.build_features(loans(s, d), "user_id").na.fill(-9, ["max_pay_status"]),
        """SELECT user_id, bill_amt_1/credit_limit AS utilization_1,
          coalesce(max_pay_status, -9) AS max_pay_status,
          """
        + "+".join(f"CAST(coalesce(pay_status_{i}>=1, FALSE) AS INT)" for i in range(1, 7))
        + """ AS n_overdue_months,
          CASE WHEN bill_amt_2 > 0 AND pay_amt_1 IS NOT NULL
            THEN least(pay_amt_1/bill_amt_2, 5.0) END AS repay_ratio_1 FROM v""",
    )
    add(
        "assigned_fields",
        "M1 M2 M3",
        "channel, loan_month, city_tier, n:i",
        lambda s, d: _planted(s, d)
        .groupBy("channel", "loan_month", "city_tier")
        .agg(F.count(F.lit(1)).alias("n")),
        "SELECT channel, loan_month, city_tier, count(*) AS n FROM planted GROUP BY ALL",
        (OBS_SQL, _planted_sql()),
    )
    add(
        "assigned_rate_matrix",
        "M4 A8",
        "loan_month, " + ", ".join(f"{c}:3" for c in CHANNELS),
        lambda s, d: C.rate_matrix(_planted(s, d), "loan_month", "channel", CHANNELS),
        "SELECT loan_month, "
        + ", ".join(f"avg(is_bad) FILTER (channel='{c}') AS \"{c}\"" for c in CHANNELS)
        + " FROM planted GROUP BY 1",
        (OBS_SQL, _planted_sql()),
    )
    add(
        "assigned_volume_scan",
        "M2 O17",
        "channel, loan_month, n:i, volume_ratio:6",
        lambda s, d: C.volume_anomaly(_planted(s, d)),
        """SELECT channel, loan_month, n, n*(count(*) OVER w-1)/CAST(sum(n) OVER w-n AS DOUBLE)
          AS volume_ratio FROM (SELECT channel, loan_month, count(*) AS n FROM planted GROUP BY ALL)
        WINDOW w AS (PARTITION BY channel)""",
        (OBS_SQL, _planted_sql()),
    )
    add(
        "uniform_draws",
        "M1",
        "tenth:i, n:i",
        lambda s, d: obs(s, d)
        .groupBy(F.floor(uniform_draw(F.col("user_id"), 1) * 10).alias("tenth"))
        .agg(F.count(F.lit(1)).alias("n")),
        f"SELECT floor({draw_sql('user_id', 1)}*10) AS tenth, count(*) AS n FROM v GROUP BY 1",
    )
    add(
        "stratified_split",
        "M6",
        "user_id:i, is_bad:i, dataset",
        lambda s, d: S.stratified_split(loans(s, d).select("user_id", "is_bad")),
        "SELECT user_id, is_bad, dataset FROM sp",
        (OBS_SQL, _split_sql()),
    )
    add(
        "boosted_tree_metrics",
        "M7 M8 M10",
        "n_features:i, n_train:i, n_valid:i, n_test:i, status_auc:6, patience:i, auc_agrees, "
        "best_iteration_holds, beats_status",
        _boosted_metrics,
        f"""SELECT {len(FEATURES)} AS n_features, count(*) FILTER (dataset = 'train') AS n_train,
          count(*) FILTER (dataset = 'valid') AS n_valid, count(*) FILTER (dataset = 'test') AS n_test,
          (SELECT auc FROM one) AS status_auc, 50 AS patience, 'true' AS auc_agrees,
          'true' AS best_iteration_holds, 'true' AS beats_status FROM sp""",
        (
            OBS_SQL,
            _split_sql(),
            """trained AS (SELECT max_pay_status AS status, v.is_bad FROM v JOIN sp USING (user_id)
              WHERE sp.dataset = 'train' AND max_pay_status IS NOT NULL)""",
            f"one AS ({auc_sql('trained', 'status')})",
        ),
    )
    add(
        "boosted_tree_attributions",
        "M9",
        "n:i, spread:6",
        _boosted_gap,
        "SELECT count(*) AS n, 0.0 AS spread FROM v",
    )
