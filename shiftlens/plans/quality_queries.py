"""Data quality and result checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.catalog import EDUCATION_CODES, LOAN_COLUMNS, MARRIAGE_CODES, STATUS_COLUMNS
from shiftlens.operators import cohort as C, findings as N, predicates as X, quality as K
from shiftlens.plans.binding import OBS_SQL, SHAP_SQL, attributions, observations as obs, table
from shiftlens.plans.cohort_queries import EARLY, LATE, S1_B, S1_T, S2_B, S2_T
from shiftlens.plans.registry import add
from shiftlens.plans.sqltext import DIMENSION_SQL, auc_sql

SPEC = "check_name, subject, severity, value:6"
BY_MONTH = "(SELECT channel, loan_month, count(*) AS n, avg(is_bad) AS bad_rate FROM v GROUP BY ALL)"
SCORE_VIEW = ["risk_score", "risk_level", "dataset"]


def register() -> None:
    columns = LOAN_COLUMNS + SCORE_VIEW
    status_bad = " OR ".join(
        f"coalesce({c} < -2 OR {c} > 9, FALSE)" for c in STATUS_COLUMNS
    )
    rules = {
        "education_undefined": "NOT coalesce(education IN (1,2,3,4), FALSE)",
        "marriage_undefined": "NOT coalesce(marriage IN (1,2,3), FALSE)",
        "bill_amt_1_negative": "bill_amt_1 < 0",
        "age_out_of_range": "age < 18 OR age > 100",
        "credit_limit_not_positive": "credit_limit <= 0",
        "pay_status_out_of_range": status_bad,
    }
    for name, cond in (("", "TRUE"), ("_late", LATE)):
        counted = [f"SELECT 'total' AS check_name, count(*) AS n_hit FROM v WHERE {cond}"]
        counted += [
            f"SELECT '{k}', count(*) FILTER ({r}) FROM v WHERE {cond}" for k, r in rules.items()
        ]
        counted += [
            f"SELECT 'null:{c}', count(*) FILTER ({c} IS NULL) FROM v WHERE {cond}"
            f" HAVING count(*) FILTER ({c} IS NULL) > 0"
            for c in columns
        ]
        add(
            f"quality_check{name}",
            "O15 A10 A11",
            "check_name, n_rows:i, n_hit:i, share:6",
            lambda s, d, cond=cond: K.quality_check(obs(s, d).select(*columns), cond),
            f"""SELECT check_name, n_rows, n_hit, n_hit/CAST(greatest(n_rows, 1) AS DOUBLE) AS share
            FROM ({" UNION ALL ".join(counted)}),
              (SELECT count(*) AS n_rows FROM v WHERE {cond})""",
        )
    add(
        "null_counts",
        "A10",
        "column_name, n_null:i",
        lambda s, d: K.null_counts(obs(s, d), columns),
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM v"
            for c in columns
        ),
    )
    add(
        "sample_findings",
        "Q1",
        SPEC,
        lambda s, d: N.sample_findings(
            C.rate_by(obs(s, d), "channel", "loan_month").select(
                F.concat_ws(" ", "channel", "loan_month").alias("subject"), "n"
            ),
            "subject",
        ),
        f"""SELECT 'sample_size' AS check_name, channel || ' ' || loan_month AS subject,
          CASE WHEN n < 100 THEN 'insufficient' ELSE 'indicative' END AS severity, n AS value
        FROM {BY_MONTH} WHERE n < 300""",
    )
    add(
        "result_findings_groups",
        "Q2 Q5",
        SPEC,
        lambda s, d: N.result_findings(
            C.anomaly_scan(obs(s, d).where(EARLY)).select("channel", "loan_month", "n", "bad_rate")
        ),
        f"""SELECT 'small_groups' AS check_name, 'n' AS subject,
          CASE WHEN small > 0 THEN 'insufficient' ELSE 'indicative' END AS severity,
          CASE WHEN small > 0 THEN small ELSE mid END AS value
        FROM (SELECT count(*) FILTER (n < 100) AS small,
          count(*) FILTER (n >= 100 AND n < 300) AS mid FROM (SELECT count(*) AS n FROM v
          WHERE {EARLY} GROUP BY channel, loan_month)) WHERE small > 0 OR mid > 0""",
    )
    add(
        "result_findings_nulls",
        "Q5",
        SPEC,
        lambda s, d: N.result_findings(obs(s, d).select("user_id", "bill_amt_1", "bill_amt_6")),
        """SELECT 'null_values' AS check_name, c AS subject, 'warn' AS severity, k AS value FROM
          (SELECT 'bill_amt_1' AS c, count(*) FILTER (bill_amt_1 IS NULL) AS k FROM v
           UNION ALL SELECT 'bill_amt_6', count(*) FILTER (bill_amt_6 IS NULL) FROM v)
        WHERE k > 0""",
    )
    add(
        "result_findings_rates",
        "Q6 Q7",
        SPEC,
        lambda s, d: N.result_findings(
            C.rate_by(obs(s, d), "city_tier").select(
                "city_tier",
                (F.col("bad_rate") * 100).alias("rate_in_percent"),
                (F.col("bad_rate") * 1000).alias("rate_in_permille"),
                (F.col("bad_rate") - 1).alias("share_below_zero"),
                F.round("bad_rate", 2).alias("coarse_ratio"),
                F.col("bad_rate").alias("fine_ratio"),
            )
        ),
        """SELECT t.check_name, t.subject, t.severity, CASE t.subject
            WHEN 'rate_in_percent' THEN hi*100 WHEN 'rate_in_permille' THEN hi*1000
            WHEN 'share_below_zero' THEN lo-1 ELSE k END AS value
        FROM (SELECT min(r) AS lo, max(r) AS hi, count(*) AS k FROM
            (SELECT avg(is_bad) AS r FROM v GROUP BY city_tier)),
          (VALUES ('rate_scaled', 'rate_in_percent', 'warn'),
            ('rate_out_of_range', 'rate_in_permille', 'error'),
            ('rate_out_of_range', 'share_below_zero', 'error'),
            ('rate_too_coarse', 'coarse_ratio', 'warn')) t(check_name, subject, severity)""",
    )
    add(
        "result_findings_empty",
        "Q3",
        SPEC,
        lambda s, d: N.result_findings(
            C.rate_by(C.cohort(obs(s, d), "loan_month = '1900-01'"), "channel")
        ),
        """SELECT 'empty_result' AS check_name, '' AS subject, 'error' AS severity,
          count(*) AS value FROM v WHERE loan_month = '1900-01'""",
    )
    add(
        "result_findings_no_match",
        "Q4 Q5",
        SPEC,
        lambda s, d: N.result_findings(C.cohort_rate(obs(s, d), "loan_month = '1900-01'")),
        """SELECT check_name, subject, severity, 1 AS value FROM
          (SELECT count(*) AS n FROM v WHERE loan_month = '1900-01'),
          (VALUES ('no_match', '', 'error'), ('null_values', 'bad_rate', 'warn'))
            t(check_name, subject, severity) WHERE n = 0""",
    )
    add(
        "undefined_code_findings",
        "Q8",
        SPEC,
        lambda s, d: N.undefined_code_findings(
            obs(s, d), {"education": EDUCATION_CODES, "marriage": MARRIAGE_CODES}, LATE
        ),
        f"""SELECT 'undefined_code' AS check_name, c AS subject, 'warn' AS severity, k AS value
        FROM (SELECT 'education' AS c, count(*) FILTER (education NOT IN (1,2,3,4)) AS k
            FROM v WHERE {LATE}
          UNION ALL SELECT 'marriage', count(*) FILTER (marriage NOT IN (1,2,3))
            FROM v WHERE {LATE}) WHERE k > 0""",
    )
    add(
        "split_metric_findings",
        "Q9",
        SPEC,
        lambda s, d: N.split_metric_findings(obs(s, d)),
        f"""SELECT 'metric_off_test' AS check_name, dataset AS subject,
          CASE WHEN gap > 0 THEN 'warn' ELSE 'info' END AS severity, gap AS value
        FROM (SELECT dataset, auc - max(CASE WHEN dataset='test' THEN auc END) OVER () AS gap
          FROM ({auc_sql("v", by="dataset")})) WHERE dataset <> 'test'""",
    )
    add(
        "simple_mean_findings",
        "Q10",
        SPEC,
        lambda s, d: N.simple_mean_findings(obs(s, d), "loan_month"),
        """SELECT 'mean_of_rates' AS check_name, 'loan_month' AS subject, 'warn' AS severity,
          gap AS value FROM (SELECT avg(r)-sum(b)/CAST(sum(n) AS DOUBLE) AS gap FROM
          (SELECT count(*) AS n, sum(is_bad) AS b, avg(is_bad) AS r FROM v GROUP BY loan_month))
        WHERE abs(gap) > 1e-4""",
    )
    add(
        "domain_findings_loans",
        "Q11",
        SPEC,
        lambda s, d: N.domain_findings(
            obs(s, d),
            {
                "channel": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"],
                "dataset": ["train", "valid", "test"],
            },
            {"loan_month": "^(199[5-9]|2000)-(0[1-9]|1[0-2])$"},
        ),
        """SELECT 'unknown_value' AS check_name, c AS subject, 'error' AS severity, count(*) AS value
        FROM (SELECT 'channel=' || channel AS c FROM v WHERE channel = 'MACHINERY'
          UNION ALL SELECT 'loan_month=' || loan_month FROM v WHERE loan_month > '2000-12')
        GROUP BY c""",
    )
    add(
        "domain_findings_lines",
        "Q11",
        SPEC,
        lambda s, d: N.domain_findings(
            table(s, d, "lineitem"), {"l_returnflag": ["A", "R"], "l_linestatus": ["F"]}
        ),
        """SELECT 'unknown_value' AS check_name, c AS subject, 'error' AS severity, count(*) AS value
        FROM (SELECT 'l_returnflag=' || l_returnflag AS c FROM lineitem
            WHERE l_returnflag NOT IN ('A', 'R')
          UNION ALL SELECT 'l_linestatus=' || l_linestatus FROM lineitem WHERE l_linestatus <> 'F')
        GROUP BY c""",
    )
    add(
        "domain_findings_documents",
        "Q11",
        SPEC,
        lambda s, d: N.domain_findings(
            table(s, d, "documents").select("lang"), {"lang": ["en", "fr", "de"]}
        ),
        """SELECT 'unknown_value' AS check_name, 'lang=' || lang AS subject, 'error' AS severity,
          count(*) AS value FROM documents WHERE lang NOT IN ('en', 'fr', 'de') GROUP BY lang""",
        (),
    )
    wrong = "CASE WHEN n_nationkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END"
    month = "CASE WHEN n_nationkey % 7 = 0 THEN '1998/06' ELSE '1998-06' END"
    region = "CASE WHEN n_regionkey = 4 THEN 'MIDDLE-EAST' ELSE r_name END"

    def filters(s, d):
        places = table(s, d, "nation").join(table(s, d, "region"), F.expr("n_regionkey = r_regionkey"))
        people = table(s, d, "customer").join(places, F.expr("c_nationkey = n_nationkey"))
        return people.selectExpr(
            "c_custkey AS id",
            f"""concat("Channel = '", {wrong}, "' AND city_tier NOT IN ('ASIA', '", {region},
              "') AND loan_month >= '", {month}, "'", CASE WHEN n_nationkey = 3
              THEN ' AND user_id IN (SELECT 1)' WHEN n_nationkey = 4 THEN ' -- all' ELSE '' END) AS filter""",
        )

    add(
        "filter_findings",
        "P1 Q11",
        "id:i, check_name, subject, severity",
        lambda s, d: X.filter_findings(
            filters(s, d).withColumn(
                "filter", F.concat("filter", F.lit(" OR 'GIRO''S' = channel OR channel = 'BUILDING'"))
            ),
            X.domain(obs(s, d), ["channel", "city_tier"]),
            ["channel", "city_tier"],
            {"loan_month": "^[0-9]{4}-(0[1-9]|1[0-2])$"},
        ).where("check_name NOT IN ('comment_or_statement', 'subquery_or_command')"),
        f"""SELECT id, check_name, subject, 'error' AS severity FROM (
          SELECT c_custkey AS id, 'unknown_value' AS check_name, 'channel=' || lower(c_mktsegment) AS subject
            FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 = 0
          UNION ALL SELECT c_custkey, 'unknown_value', 'city_tier=MIDDLE-EAST'
            FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4
          UNION ALL SELECT c_custkey, 'odd_format', 'loan_month=1998/06' FROM customer WHERE c_nationkey % 7 = 0
          UNION ALL SELECT c_custkey, 'unknown_value', 'channel=GIRO''S' FROM customer)""",
        (),
    )
    add(
        "refused_filters",
        "P1",
        "id:i, check_name, severity",
        lambda s, d: X.refused(filters(s, d)),
        """SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'subquery_or_command'
          ELSE 'comment_or_statement' END AS check_name, 'error' AS severity
        FROM customer WHERE c_nationkey IN (3, 4)""",
        (),
    )
    add(
        "dimension_findings",
        "P12",
        SPEC,
        lambda s, d: N.dimension_findings(
            table(s, d, "customer").selectExpr("IF(c_nationkey < 12, 'channel', lower(c_mktsegment)) AS name")
        ),
        """SELECT 'unknown_dimension' AS check_name, lower(c_mktsegment) AS subject, 'error' AS severity,
          count(*) AS value FROM customer WHERE NOT c_nationkey < 12 GROUP BY 2""",
        (),
    )
    add(
        "groups_sum_findings",
        "Q12",
        SPEC,
        # groups of one period against the total of all: the difference is the finding
        lambda s, d: N.groups_sum_findings(
            C.rate_by(C.cohort(obs(s, d), LATE), "channel"),
            "n",
            obs(s, d).agg(F.count(F.lit(1))),
        ),
        f"""SELECT 'groups_sum' AS check_name, 'n' AS subject, 'error' AS severity,
          count(*) FILTER ({LATE}) - count(*) AS value FROM v
        HAVING count(*) FILTER ({LATE}) <> count(*)""",
    )
    add(
        "score_findings",
        "Q13",
        SPEC,
        # log-odds in place of the score
        lambda s, d: N.score_findings(
            obs(s, d).withColumn("risk_score", F.log(F.col("p") / (1 - F.col("p"))))
        ),
        """SELECT 'score_out_of_range' AS check_name, 'risk_score' AS subject, 'error' AS severity,
          count(*) AS value FROM v WHERE ln(p/(1-p)) < 0 OR ln(p/(1-p)) > 1 HAVING count(*) > 0""",
    )
    add(
        "score_findings_missing",
        "Q13",
        SPEC,
        lambda s, d: N.score_findings(
            obs(s, d).withColumn("risk_score", F.col("p") * F.signum("bill_amt_6"))
        ),
        """SELECT 'score_missing' AS check_name, 'risk_score' AS subject, 'error' AS severity,
          count(*) AS value FROM v WHERE bill_amt_6 IS NULL HAVING count(*) > 0""",
    )
    add(
        "identity_findings",
        "Q14",
        SPEC,
        lambda s, d: N.identity_findings(obs(s, d), "limit_band", LATE, EARLY),
        f"""SELECT 'identity' AS check_name, 'diff' AS subject, 'error' AS severity, off AS value
        FROM (SELECT abs(sum((st-sb)*rb + st*(rt-rb)) - (sum(bt)/sum(nt) - sum(bb)/sum(nb))) AS off
          FROM (SELECT *, nt/sum(nt) OVER () AS st, nb/sum(nb) OVER () AS sb,
            coalesce(bt/nullif(nt, 0), 0) AS rt, coalesce(bb/nullif(nb, 0), 0) AS rb
            FROM (SELECT {DIMENSION_SQL["limit_band"]} AS g,
              CAST(count(*) FILTER ({LATE}) AS DOUBLE) AS nt,
              CAST(count(*) FILTER ({EARLY}) AS DOUBLE) AS nb,
              CAST(coalesce(sum(is_bad) FILTER ({LATE}), 0) AS DOUBLE) AS bt,
              CAST(coalesce(sum(is_bad) FILTER ({EARLY}), 0) AS DOUBLE) AS bb
              FROM v GROUP BY 1))) WHERE off > 1e-6""",
    )
    add(
        "additivity_findings",
        "Q15 O14",
        SPEC,
        # attributions of another score break additivity for a high-risk cohort
        lambda s, d: N.additivity_findings(
            attributions(obs(s, d)).withColumn("shap_value", F.col("shap_value") * 2),
            obs(s, d),
            "risk_level = '高'",
        ),
        """SELECT 'additivity' AS check_name, 'log_odds' AS subject, 'error' AS severity,
          gap AS value FROM (SELECT abs(avg(l) FILTER (risk_level='高') - avg(l-s)
            - avg(s) FILTER (risk_level='高')) AS gap
          FROM (SELECT risk_level, ln(risk_score/(1-risk_score)) AS l, s FROM v JOIN
            (SELECT user_id, 2*sum(shap_value) AS s FROM shap GROUP BY 1) USING (user_id)))
        WHERE gap > 0.05""",
        (OBS_SQL, SHAP_SQL),
    )
    groups = f"(SELECT education, count(*) AS n FROM v WHERE {S2_T} GROUP BY 1)"
    add(
        "compare_findings",
        "Q1 Q2 Q8 Q14",
        SPEC,
        lambda s, d: N.compare_findings(obs(s, d), "education", S2_T, S2_B),
        f"""SELECT 'sample_size' AS check_name, side AS subject,
          CASE WHEN n < 100 THEN 'insufficient' ELSE 'indicative' END AS severity, n AS value
        FROM (SELECT 'target' AS side, count(*) AS n FROM v WHERE {S2_T}
          UNION ALL SELECT 'base', count(*) FROM v WHERE {S2_B}) WHERE n < 300 AND n > 0
        UNION ALL SELECT 'small_groups', 'n', 'insufficient', count(*) FROM {groups}
          WHERE n < 100 HAVING count(*) > 0
        UNION ALL SELECT 'undefined_code', 'education', 'warn', count(*) FROM v
          WHERE {S2_T} AND education NOT IN (1,2,3,4) HAVING count(*) > 0""",
    )

    def sizes_sql(**sides: str) -> str:
        counts = " UNION ALL ".join(
            f"SELECT '{k}' AS side, count(*) AS n FROM v WHERE {c}" for k, c in sides.items()
        )
        return f"""SELECT CASE WHEN n = 0 THEN 'empty_' || side ELSE 'sample_size' END AS check_name,
          side AS subject, CASE WHEN n = 0 THEN 'error' WHEN n < 100 THEN 'insufficient'
          ELSE 'indicative' END AS severity, CAST(n AS DOUBLE) AS value FROM ({counts}) WHERE n < 300"""

    two = sizes_sql(target=S1_T, base=S1_B)
    add(
        "summary_findings",
        "Q1 Q13 O5",
        SPEC,
        lambda s, d: N.summary_findings(
            obs(s, d).withColumn(
                "risk_score", F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("risk_score"))
            ),
            S1_T,
            S1_B,
        ),
        f"""{two} UNION ALL SELECT 'score_missing', 'risk_score', 'error',
          count(*) FROM v WHERE {S1_T} AND user_id % 5 = 0 HAVING count(*) > 0""",
    )
    one_label = "is_bad = 1"
    add(
        "performance_findings",
        "Q1 O9",
        SPEC,
        lambda s, d: N.performance_findings(obs(s, d), one_label),
        f"""{sizes_sql(target=f"{one_label} AND dataset = 'test'")} UNION ALL SELECT 'single_label',
          'is_bad', 'error', count(*) FROM v WHERE {one_label} AND dataset = 'test' HAVING count(*) > 0""",
    )
    add(
        "quality_findings",
        "Q1 Q8 O15",
        SPEC,
        lambda s, d: N.quality_findings(obs(s, d), S1_T),
        f"""{sizes_sql(target=S1_T)} UNION ALL SELECT 'undefined_code', 'education', 'warn', count(*) FROM v
          WHERE {S1_T} AND NOT coalesce(education IN (1,2,3,4), FALSE) HAVING count(*) > 0
        UNION ALL SELECT 'undefined_code', 'marriage', 'warn', count(*) FROM v
          WHERE {S1_T} AND NOT coalesce(marriage IN (1,2,3), FALSE) HAVING count(*) > 0""",
    )
    add(
        "attribution_findings",
        "Q1 Q15 O12",
        SPEC,
        lambda s, d: N.attribution_findings(attributions(obs(s, d)), obs(s, d), S1_T, S1_B, 1e-12),
        f"""WITH per AS (SELECT user_id, sum(shap_value) AS total FROM shap GROUP BY 1),
          u AS (SELECT v.*, total, ln(greatest(least(risk_score, 1-1e-6), 1e-6)
            /(1-greatest(least(risk_score, 1-1e-6), 1e-6))) AS odds FROM v LEFT JOIN per USING (user_id)),
          g AS (SELECT avg(odds - total) AS rest, avg(odds) FILTER ({S1_T}) AS ot, avg(total) FILTER ({S1_T}) AS tt,
            avg(odds) FILTER ({S1_B}) AS ob, avg(total) FILTER ({S1_B}) AS tb FROM u)
        SELECT * FROM ({two}) UNION ALL
          SELECT 'additivity', side, 'error', gap FROM
            (SELECT 'target' AS side, abs(ot - rest - tt) AS gap FROM g
             UNION ALL SELECT 'base', abs(ob - rest - tb) FROM g) WHERE gap > 1e-12""",
        (OBS_SQL, SHAP_SQL),
    )
    # the same checks for other cohorts
    late_and_early = sizes_sql(target=LATE, base=EARLY)
    add(
        "summary_findings_late",
        "Q1 Q13 O5",
        SPEC,
        lambda s, d: N.summary_findings(
            obs(s, d).withColumn("risk_score", F.col("p") * F.signum("bill_amt_6")), LATE, EARLY
        ),
        f"""{late_and_early} UNION ALL SELECT 'score_missing', 'risk_score', 'error', count(*)
          FROM v WHERE {LATE} AND bill_amt_6 IS NULL HAVING count(*) > 0""",
    )
    add(
        "quality_findings_all",
        "Q1 Q8 O15",
        SPEC,
        lambda s, d: N.quality_findings(obs(s, d)),
        f"""{sizes_sql(target="TRUE")} UNION ALL SELECT 'undefined_code', 'education', 'warn', count(*) FROM v
          WHERE NOT coalesce(education IN (1,2,3,4), FALSE) HAVING count(*) > 0
        UNION ALL SELECT 'undefined_code', 'marriage', 'warn', count(*) FROM v
          WHERE NOT coalesce(marriage IN (1,2,3), FALSE) HAVING count(*) > 0""",
    )
    add(
        "attribution_findings_late",
        "Q1 Q15 O12",
        SPEC,
        lambda s, d: N.attribution_findings(attributions(obs(s, d)), obs(s, d), LATE, EARLY, 1e-12),
        f"""WITH per AS (SELECT user_id, sum(shap_value) AS total FROM shap GROUP BY 1),
          u AS (SELECT v.*, total, ln(greatest(least(risk_score, 1-1e-6), 1e-6)
            /(1-greatest(least(risk_score, 1-1e-6), 1e-6))) AS odds FROM v LEFT JOIN per USING (user_id)),
          g AS (SELECT avg(odds - total) AS rest, avg(odds) FILTER ({LATE}) AS ot, avg(total) FILTER ({LATE}) AS tt,
            avg(odds) FILTER ({EARLY}) AS ob, avg(total) FILTER ({EARLY}) AS tb FROM u)
        SELECT * FROM ({late_and_early}) UNION ALL
          SELECT 'additivity', side, 'error', gap FROM
            (SELECT 'target' AS side, abs(ot - rest - tt) AS gap FROM g
             UNION ALL SELECT 'base', abs(ob - rest - tb) FROM g) WHERE gap > 1e-12""",
        (OBS_SQL, SHAP_SQL),
    )
