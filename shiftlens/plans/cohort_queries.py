"""Cohort profiles, comparisons, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.catalog import DIMENSIONS, worst_status
from shiftlens.operators import cohort as C
from shiftlens.operators.significance import chi_square_independence, contingency_table
from shiftlens.plans.binding import observations as obs
from shiftlens.plans.registry import add
from shiftlens.plans.sqltext import DIMENSION_SQL, erfc_sql, p_sql, z_sql

LATE, EARLY = "loan_month >= '2001-01'", "loan_month < '2001-01'"
S1_T = "channel = 'BUILDING' AND loan_month >= '2000-10'"
S1_B = "channel = 'BUILDING' AND loan_month < '2000-10'"
S2_T = "channel = 'MACHINERY' AND loan_month = '1998-06'"
S2_B = "channel = 'MACHINERY' AND loan_month <> '1998-06'"
YOUNG_LOW = "age <= 30 AND credit_limit <= 50000"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

NAMED = {
    "last_quarter": "loan_month >= '2000-10'",
    "one_channel_month": S2_T,
    "region": "city_tier = 'ASIA'",
    "low_limit": "credit_limit <= 30000",
    "young_low": YOUNG_LOW,
    "middle": "age BETWEEN 31 AND 40 AND credit_limit > 100000 AND credit_limit <= 200000",
    "revolving": "pay_status_1 = 0",
    "overdue": "pay_status_1 >= 1",
    "high_use": "bill_amt_1 * 1.0 / credit_limit >= 0.8",
    "unknown_education": "education NOT IN (1, 2, 3, 4)",
    "tiny": "city_tier = 'ASIA' AND channel = 'MACHINERY' AND loan_month = '2000-12' AND age > 50",
}


def register() -> None:
    add(
        "cohort_rate_all",
        "A6 P1",
        "n:i, bad_rate:6",
        lambda s, d: C.cohort_rate(obs(s, d), "  "),
        "SELECT count(*) AS n, avg(is_bad) AS bad_rate FROM v",
    )
    add(
        "cohort_rates_named",
        "A6 P1 P20 P21",
        "cohort, n:i, bad_rate:6",
        lambda s, d: C.cohort_rates(obs(s, d), NAMED),
        " UNION ALL ".join(
            f"SELECT '{k}' AS cohort, count(*) AS n, avg(is_bad) AS bad_rate FROM v WHERE {e}"
            f" HAVING count(*) > 0"
            for k, e in NAMED.items()
        ),
    )
    for name in DIMENSIONS:
        add(
            f"profile_{name}",
            "O1 A1 A2 A3 L1",
            "segment, n:i, share:6, bad_rate:6, avg_score:6, overall_rate:6",
            lambda s, d, name=name: C.segment_profile(obs(s, d), name, LATE),
            f"""SELECT {DIMENSION_SQL[name]} AS segment, count(*) AS n,
              count(*)/CAST(sum(count(*)) OVER () AS DOUBLE) AS share, avg(is_bad) AS bad_rate,
              avg(risk_score) AS avg_score,
              CAST(sum(sum(is_bad)) OVER () AS DOUBLE)/sum(count(*)) OVER () AS overall_rate
            FROM v WHERE {LATE} GROUP BY 1""",
        )
    add(
        "profile_all_dimensions",
        "P3 P4 P5 P6 P7 P8 P9 P10 P11 P13",
        "dimension, segment, n:i, share:6, bad_rate:6, avg_score:6",
        lambda s, d: C.profile_all(obs(s, d)),
        " UNION ALL ".join(
            f"""SELECT '{k}' AS dimension, {e} AS segment, count(*) AS n,
            count(*)/CAST(sum(count(*)) OVER () AS DOUBLE) AS share, avg(is_bad) AS bad_rate,
            avg(risk_score) AS avg_score FROM v GROUP BY 2"""
            for k, e in DIMENSION_SQL.items()
        ),
    )

    def compare_ctes(dim: str, t: str, b: str) -> str:
        side = (
            "SELECT {e} AS segment, count(*) AS n, sum(is_bad) AS bad, avg(is_bad) AS r"
            " FROM v WHERE {w} GROUP BY 1"
        )
        e = DIMENSION_SQL[dim]
        return f"""bs AS ({side.format(e=e, w=b)}), tg AS ({side.format(e=e, w=t)}),
        cmp AS (SELECT coalesce(bs.segment, tg.segment) AS segment, coalesce(bs.n, 0) AS n_base,
          coalesce(bs.n, 0)/CAST((SELECT sum(n) FROM bs) AS DOUBLE) AS share_base,
          coalesce(bs.r, 0) AS bad_rate_base, coalesce(tg.n, 0) AS n_target,
          coalesce(tg.n, 0)/CAST((SELECT sum(n) FROM tg) AS DOUBLE) AS share_target,
          coalesce(tg.r, 0) AS bad_rate_target, coalesce(bs.bad, 0) AS bad_base,
          coalesce(tg.bad, 0) AS bad_target
        FROM bs FULL JOIN tg ON bs.segment IS NOT DISTINCT FROM tg.segment),
        eff AS (SELECT *, (share_target-share_base)*bad_rate_base AS mix_effect,
          share_target*(bad_rate_target-bad_rate_base) AS rate_effect FROM cmp)"""

    from shiftlens.plans.binding import OBS_SQL

    cases = {
        "channel": (LATE, EARLY),
        "limit_band": (S1_T, S1_B),
        "young_low": (S1_T, S1_B),
        "recent_overdue": (S2_T, S2_B),
        "max_overdue": (S2_T, S2_B),
        "education": (LATE, EARLY),
        # cohorts that overlap
        "city_tier": (LATE, "credit_limit > 100000"),
    }
    for dim, (t, b) in cases.items():
        ctes = (OBS_SQL, compare_ctes(dim, t, b))
        add(
            f"segment_compare_{dim}",
            "O2 J3",
            "segment, n_base:i, share_base:6, bad_rate_base:6, n_target:i, share_target:6,"
            " bad_rate_target:6, mix_effect:6, rate_effect:6",
            lambda s, d, dim=dim, t=t, b=b: C.segment_compare(obs(s, d), dim, t, b),
            "SELECT * FROM eff",
            ctes,
        )
        z = z_sql("bt", "nt", "bb", "nb")
        add(
            f"compare_summary_{dim}",
            "O2 O3 A3",
            "n_base:i, rate_base:6, n_target:i, rate_target:6, diff:6, z:6, p_value:6,"
            " mix_effect:6, rate_effect:6, mix_pct:4",
            lambda s, d, dim=dim, t=t, b=b: C.compare_summary(obs(s, d), dim, t, b),
            f"""SELECT nb AS n_base, bb/CAST(nb AS DOUBLE) AS rate_base, nt AS n_target,
              bt/CAST(nt AS DOUBLE) AS rate_target, bt/CAST(nt AS DOUBLE)-bb/CAST(nb AS DOUBLE) AS diff,
              z, {p_sql("z")} AS p_value, mix_effect, rate_effect,
              mix_effect/nullif(bt/CAST(nt AS DOUBLE)-bb/CAST(nb AS DOUBLE), 0) AS mix_pct
            FROM (SELECT *, {z} AS z FROM (SELECT sum(n_base) AS nb, sum(bad_base) AS bb,
              sum(n_target) AS nt, sum(bad_target) AS bt, sum(mix_effect) AS mix_effect,
              sum(rate_effect) AS rate_effect FROM eff))""",
            ctes,
        )

    alone = f"""SELECT {DIMENSION_SQL["channel"]} AS segment, count(*) AS n, avg(is_bad) AS bad_rate,
      count(*)/CAST(sum(count(*)) OVER () AS DOUBLE) AS share, avg(risk_score) AS avg_score
      FROM v WHERE {LATE} GROUP BY 1"""
    add(
        "segment_compare_alone",
        "O2",
        "segment, n:i, share:6, bad_rate:6, avg_score:6",
        lambda s, d: C.segment_compare(obs(s, d), "channel", LATE),
        alone,
    )
    add(
        "compare_summary_alone",
        "O2",
        "n_base:i, n_target:i, rate_base:6, rate_target:6, diff:6",
        lambda s, d: C.compare_summary(obs(s, d), "channel", LATE, " "),
        f"""SELECT 0 AS n_base, count(*) AS n_target, CAST(NULL AS DOUBLE) AS rate_base,
          avg(is_bad) AS rate_target, CAST(NULL AS DOUBLE) AS diff FROM v WHERE {LATE}""",
    )
    add(
        "share_shift_alone",
        "O22",
        "share_base:6, share_target:6, shift:6",
        lambda s, d: C.share_shift(obs(s, d), YOUNG_LOW, S1_T),
        f"""SELECT CAST(NULL AS DOUBLE) AS share_base, avg(CAST({YOUNG_LOW} AS INT)) AS share_target,
          CAST(NULL AS DOUBLE) AS shift FROM v WHERE {S1_T}""",
    )
    add(
        "indicator_rates",
        "P19 P20 A16",
        "overdue_now:6, high_risk:6, overdue_ever:6, high_use:6",
        lambda s, d: C.indicator_rates(
            obs(s, d),
            {
                "overdue_now": F.col("pay_status_1") >= 1,
                "high_risk": F.col("risk_level") == "高",
                "overdue_ever": worst_status() >= 1,
                "high_use": F.col("bill_amt_1") / F.col("credit_limit") >= 0.8,
            },
        ),
        """SELECT avg(CAST(pay_status_1>=1 AS INT)) AS overdue_now,
          avg(CAST(risk_level='高' AS INT)) AS high_risk,
          avg(CAST(max_pay_status>=1 AS INT)) AS overdue_ever,
          avg(CAST(bill_amt_1/credit_limit>=0.8 AS INT)) AS high_use FROM v""",
    )
    add(
        "rate_by_channel_month",
        "A7",
        "channel, loan_month, n:i, bad_rate:6",
        lambda s, d: C.rate_by(obs(s, d), "channel", "loan_month"),
        "SELECT channel, loan_month, count(*) AS n, avg(is_bad) AS bad_rate FROM v GROUP BY ALL",
    )
    add(
        "rate_matrix",
        "A8 M4",
        "loan_month, " + ", ".join(f"{c}:3" for c in SEGMENTS),
        lambda s, d: C.rate_matrix(obs(s, d), "loan_month", "channel", SEGMENTS),
        "SELECT loan_month, "
        + ", ".join(f"avg(is_bad) FILTER (channel='{c}') AS {c}" for c in SEGMENTS)
        + " FROM v GROUP BY 1",
    )
    add(
        "volume_matrix",
        "A8",
        "loan_month, " + ", ".join(f"{c}:0" for c in SEGMENTS),
        lambda s, d: C.volume_matrix(obs(s, d), "loan_month", "channel", SEGMENTS),
        "SELECT loan_month, "
        + ", ".join(f"nullif(count(*) FILTER (channel='{c}'), 0) AS {c}" for c in SEGMENTS)
        + " FROM v GROUP BY 1",
    )
    for dim in ("age_band", "limit_band", "channel"):
        add(
            f"best_and_worst_{dim}",
            "A9 L7",
            "worst_segment, worst_rate:6, best_segment, best_rate:6",
            lambda s, d, dim=dim: C.extreme_segment(obs(s, d), dim),
            f"""SELECT a.g AS worst_segment, a.r AS worst_rate, b.g AS best_segment,
              b.r AS best_rate FROM
              (SELECT {DIMENSION_SQL[dim]} AS g, avg(is_bad) AS r FROM v GROUP BY 1
                ORDER BY r DESC, g LIMIT 1) a,
              (SELECT {DIMENSION_SQL[dim]} AS g, avg(is_bad) AS r FROM v GROUP BY 1
                ORDER BY r, g LIMIT 1) b""",
        )
    add(
        "weighted_vs_simple_rate",
        "O21 A15",
        "weighted_rate:6, simple_rate:6, n_groups:i, gap:6",
        lambda s, d: C.weighted_vs_simple_rate(obs(s, d), "loan_month"),
        """SELECT sum(b)/CAST(sum(n) AS DOUBLE) AS weighted_rate, avg(r) AS simple_rate,
          count(*) AS n_groups, avg(r)-sum(b)/CAST(sum(n) AS DOUBLE) AS gap
        FROM (SELECT count(*) AS n, sum(is_bad) AS b, avg(is_bad) AS r FROM v GROUP BY loan_month)""",
    )
    others = """(SELECT channel, loan_month, n, bad,
        sum(n) OVER (PARTITION BY channel)-n AS n2, sum(bad) OVER (PARTITION BY channel)-bad AS b2,
        count(*) OVER (PARTITION BY channel)-1 AS k2
      FROM (SELECT channel, loan_month, count(*) AS n, sum(is_bad) AS bad FROM v GROUP BY ALL))"""
    add(
        "anomaly_scan",
        "O16 O3 A20",
        "channel, loan_month, n:i, bad_rate:6, rate_others:6, z:6, p_value:6, diff:6, flag",
        lambda s, d: C.anomaly_scan(obs(s, d)),
        f"""SELECT *, bad_rate-rate_others AS diff,
          CASE WHEN p_value<0.05 AND n>=100 AND bad_rate>rate_others THEN 'up'
            WHEN p_value<0.05 AND n>=100 AND bad_rate<rate_others THEN 'down' ELSE 'none' END AS flag
        FROM (SELECT *, {p_sql("z")} AS p_value FROM (SELECT channel, loan_month, n,
          bad/CAST(n AS DOUBLE) AS bad_rate, b2/nullif(CAST(n2 AS DOUBLE), 0) AS rate_others,
          {z_sql("bad", "n", "b2", "n2")} AS z FROM {others}))""",
    )
    add(
        "volume_anomaly",
        "O17 A20",
        "channel, loan_month, n:i, mean_others:6, volume_ratio:6",
        lambda s, d: C.volume_anomaly(obs(s, d)),
        f"""SELECT channel, loan_month, n, n2/CAST(k2 AS DOUBLE) AS mean_others,
          n/(n2/CAST(k2 AS DOUBLE)) AS volume_ratio FROM {others}""",
    )
    delta = f"""count(*) FILTER ({LATE}) AS n_in, count(*) FILTER (NOT {LATE}) AS n_out,
        avg(is_bad) FILTER ({LATE}) AS rate_in, avg(is_bad) FILTER (NOT {LATE}) AS rate_out,
        avg(is_bad) FILTER ({LATE})-avg(is_bad) FILTER (NOT {LATE}) AS delta"""
    add(
        "period_delta",
        "O18",
        "n_in:i, n_out:i, rate_in:6, rate_out:6, delta:6",
        lambda s, d: C.period_delta(obs(s, d), LATE),
        f"SELECT {delta} FROM v",
    )
    add(
        "period_delta_by_channel",
        "O18",
        "channel, n_in:i, n_out:i, rate_in:6, rate_out:6, delta:6",
        lambda s, d: C.period_delta(obs(s, d), LATE, "channel"),
        f"SELECT channel, {delta} FROM v GROUP BY 1",
    )
    add(
        "share_shift",
        "O22",
        "share_base:6, share_target:6, shift:6",
        lambda s, d: C.share_shift(obs(s, d), YOUNG_LOW, S1_T, S1_B),
        f"""SELECT *, share_target-share_base AS shift FROM (SELECT
          avg(CAST({YOUNG_LOW} AS INT)) FILTER ({S1_B}) AS share_base,
          avg(CAST({YOUNG_LOW} AS INT)) FILTER ({S1_T}) AS share_target FROM v)""",
    )
    add(
        "contingency_city",
        "A21",
        "segment, bad:i, good:i",
        lambda s, d: contingency_table(obs(s, d), F.col("city_tier")),
        """SELECT city_tier AS segment, sum(is_bad) AS bad, sum(1-is_bad) AS good
        FROM v GROUP BY 1""",
    )

    def chi(group: str) -> str:
        return f"""WITH t AS (SELECT {group} AS g, sum(is_bad) AS b, sum(1-is_bad) AS o
              FROM v GROUP BY 1),
            tot AS (SELECT sum(b) AS tb, sum(o) AS tg, count(*) AS k FROM t),
            e AS (SELECT b, o, k, CAST(b+o AS DOUBLE)*tb/(tb+tg) AS eb,
              CAST(b+o AS DOUBLE)*tg/(tb+tg) AS eo FROM t, tot),
            y AS (SELECT k, eb, eo, abs(b-eb)-CASE WHEN k=2 THEN least(0.5, abs(b-eb)) ELSE 0 END AS db,
              abs(o-eo)-CASE WHEN k=2 THEN least(0.5, abs(o-eo)) ELSE 0 END AS dg FROM e)
            SELECT sum(db*db/eb+dg*dg/eo) AS statistic, max(k)-1 AS dof FROM y"""

    add(
        "chi_square_city",
        "O4",
        "statistic:5, dof:i, p_value:6",
        lambda s, d: chi_square_independence(obs(s, d), F.col("city_tier")),
        # four degrees of freedom
        f"SELECT *, exp(-statistic/2)*(1+statistic/2) AS p_value FROM ({chi('city_tier')})",
    )
    add(
        "chi_square_sex",
        "O4",
        "statistic:5, dof:i, p_value:6",
        lambda s, d: chi_square_independence(obs(s, d), F.col("sex")),
        # one degree of freedom
        f"SELECT *, {erfc_sql('sqrt(statistic/2)')} AS p_value FROM ({chi('sex')})",
    )
    add(
        "chi_square_marriage",
        "O4",
        "statistic:5, dof:i, p_value:6",
        lambda s, d: chi_square_independence(obs(s, d), F.col("marriage")),
        # three degrees of freedom
        f"""SELECT *, {erfc_sql('sqrt(statistic/2)')}
          + exp(-statistic/2)*sqrt(statistic/2)/0.886226925452758 AS p_value
        FROM ({chi('marriage')})""",
    )
    add(
        "month_rows_shown",
        "A6 L1",
        "loan_month, n:i, bad_rate:6",
        lambda s, d: C.rate_by(obs(s, d), "loan_month").orderBy("loan_month"),
        "SELECT loan_month, count(*) AS n, avg(is_bad) AS bad_rate FROM v GROUP BY 1 ORDER BY 1",
    )
