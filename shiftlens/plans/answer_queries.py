"""Reports and run records derived from the view: evidence, grading, summaries, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from shiftlens.functions.numeric import fixed_text
from shiftlens.functions.text import ANSWER_NUMBER, REPORT_NOISE, REPORT_NUMBER, numbers
from shiftlens.operators import attribution as A, cohort as C, evidence as E, grading as G
from shiftlens.operators import monitor as M, runs as R
from shiftlens.operators.retrieval import split_sections
from shiftlens.plans.binding import (
    OBS_SQL,
    SHAP_SQL,
    attributions,
    loans,
    observations as obs,
    scores,
    table,
)
from shiftlens.plans.registry import add
from shiftlens.plans.sqltext import auc_sql, fixed_sql
from shiftlens.session import shared_folder
from shiftlens.sources import tables as T

# ---------------------------------------------------------------- reports with planted errors


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """One written report per channel and month, with the rows it was written from."""
    groups = (
        obs(spark, folder)
        .groupBy("channel", "loan_month")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("is_bad").alias("bad"),
            F.sum(F.round(F.col("risk_score") * 10000).cast("bigint")).alias("points"),
        )
    )
    same = Window.partitionBy("channel")
    totals = groups.select(
        "*", F.sum("n").over(same).alias("total"), F.sum("bad").over(same).alias("all_bad")
    )

    def four(num: str, den: str):
        # rounded in whole numbers, so that no engine's floating point decides a tie
        return F.expr(f"((2 * {num} + {den}) DIV (2 * {den})) / 10000d")

    figures = totals.select(
        "channel",
        "loan_month",
        "n",
        four("10000 * bad", "n").alias("r"),
        four("10000 * all_bad", "total").alias("c"),
        four("points", "n").alias("s"),
        "total",
    )
    wrong = F.when(F.col("n") % 5 == 0, 3.0).otherwise(0.0)
    report = F.concat(
        F.lit("渠道 "),
        "channel",
        F.lit(" 在 "),
        "loan_month",
        F.lit(" 共 "),
        F.col("n").cast("string"),
        F.lit(" 人，坏账率 "),
        fixed_text(F.col("r") * 100 + wrong, 2),
        F.lit("%，与渠道平均相差 "),
        fixed_text(F.abs(F.col("r") - F.col("c")) * 100, 2),
        F.lit("pp，平均风险分 "),
        fixed_text(F.col("s"), 4),
        F.lit("，渠道累计 "),
        F.col("total").cast("string"),
        F.lit(" 人。26-30岁客群占 3 成，pay_status_1 影响最大，Q3 起关注。"),
        F.when(F.col("n") % 7 == 0, " 另计 9876.5 与 55.5% 和 55.5%。").otherwise(""),
    )
    evidence = F.array(
        F.concat(
            F.lit("n | bad_rate | avg_score\n"),
            F.col("n").cast("string"),
            F.lit(" | "),
            fixed_text(F.col("r"), 4),
            F.lit(" | "),
            fixed_text(F.col("s"), 4),
        ),
        F.concat(
            F.lit("渠道坏账率 "),
            fixed_text(F.col("c") * 100, 2),
            F.lit("%，累计 "),
            F.format_number("total", 0),
            F.lit(" 人"),
        ),
    )
    return figures.select(
        "channel", "loan_month", report.alias("report"), evidence.alias("evidence")
    )


def _reports_sql() -> str:
    def four(num: str, den: str) -> str:
        return f"(CAST((2*{num}+{den}) AS BIGINT) // CAST(2*{den} AS BIGINT))/CAST(10000 AS DOUBLE)"

    return f"""g1 AS (SELECT channel, loan_month, count(*) AS n, sum(is_bad) AS bad,
        sum(CAST(round(risk_score*10000) AS BIGINT)) AS points FROM v GROUP BY ALL),
      g2 AS (SELECT *, sum(n) OVER w AS total, sum(bad) OVER w AS tb FROM g1
        WINDOW w AS (PARTITION BY channel)),
      g3 AS (SELECT channel, loan_month, n, total, {four("10000*bad", "n")} AS r, {four("10000*tb", "total")} AS c,
        {four("points", "n")} AS s FROM g2),
      rep AS (SELECT channel, loan_month,
        '渠道 ' || channel || ' 在 ' || loan_month || ' 共 ' || n || ' 人，坏账率 '
        || {fixed_sql("r*100 + CASE WHEN n % 5 = 0 THEN 3.0 ELSE 0.0 END", 2)} || '%，与渠道平均相差 '
        || {fixed_sql("abs(r-c)*100", 2)} || 'pp，平均风险分 ' || {fixed_sql("s", 4)}
        || '，渠道累计 ' || CAST(total AS BIGINT) || ' 人。26-30岁客群占 3 成，pay_status_1 影响最大，Q3 起关注。'
        || CASE WHEN n % 7 = 0 THEN ' 另计 9876.5 与 55.5% 和 55.5%。' ELSE '' END AS report,
        ['n | bad_rate | avg_score' || chr(10) || n || ' | ' || {fixed_sql("r", 4)} || ' | '
          || {fixed_sql("s", 4)},
         '渠道坏账率 ' || {fixed_sql("c*100", 2)} || '%，累计 ' || format('{{:,}}', CAST(total AS BIGINT))
          || ' 人'] AS evidence FROM g3)"""


LEAD = r"(?:^|[^A-Za-z0-9_.])"
LEAD_REPORT = r"(?:^|[^A-Za-z0-9_.\-])"
NUM = r"([-+]?\d+(?:,\d{3})*(?:\.\d+)?)"


def _numbers_sql(text: str, lead: str, units: str) -> str:
    """Lists of raw numbers and units; the oracle's engine has no look-behind."""
    pattern = f"{lead}{NUM}(?:\\s*({units}))?"
    return (
        f"regexp_extract_all({text}, '{pattern}', 1) AS raws,"
        f" list_transform(regexp_extract_all({text}, '{pattern}', 2),"
        " lambda u: coalesce(u, '')) AS units"
    )


def _clean_sql(text: str) -> str:
    for noise in REPORT_NOISE:
        text = f"regexp_replace({text}, '{noise}', ' ', 'g')"
    return text


def _grounding_sql() -> str:
    clean = _clean_sql("report")
    return f"""ev0 AS (SELECT channel, loan_month, unnest(evidence) AS t FROM rep),
      ev1 AS (SELECT channel, loan_month, {_numbers_sql("t", LEAD, "%")} FROM ev0),
      ev2 AS (SELECT channel, loan_month, unnest(raws) AS raw, unnest(units) AS unit FROM ev1),
      ev3 AS (SELECT channel, loan_month, CAST(replace(raw, ',', '') AS DOUBLE) AS x, unit FROM ev2),
      pool AS (SELECT DISTINCT channel, loan_month, x FROM (SELECT channel, loan_month, x FROM ev3
        UNION ALL SELECT channel, loan_month, x/100 FROM ev3 WHERE unit = '%')),
      rn1 AS (SELECT channel, loan_month, {_numbers_sql(clean, LEAD_REPORT, "%|％|pp|个百分点|百分点")} FROM rep),
      rn2 AS (SELECT channel, loan_month, generate_subscripts(raws, 1) AS pos, unnest(raws) AS raw,
        unnest(units) AS unit FROM rn1),
      rn3 AS (SELECT *, CAST(replace(raw, ',', '') AS DOUBLE) AS x,
        0.5*pow(10.0, -len(string_split(raw || '.', '.')[2])) + 1e-9 AS tol FROM rn2),
      rn AS (SELECT * FROM rn3 WHERE unit <> ''
        OR abs(x) NOT IN (0,1,2,3,4,5,6,7,8,9,10,12,100,300,2025)),
      hit AS (SELECT rn.*, EXISTS (SELECT 1 FROM pool p WHERE p.channel = rn.channel
          AND p.loan_month = rn.loan_month AND (abs(abs(p.x)-abs(rn.x)) <= tol
            OR (unit <> '' AND abs(abs(p.x*100)-abs(rn.x)) <= tol))) AS near,
        unit IN ('pp', '个百分点', '百分点') AND EXISTS (SELECT 1 FROM pool a JOIN pool b
          ON a.channel = b.channel AND a.loan_month = b.loan_month
          WHERE a.channel = rn.channel AND a.loan_month = rn.loan_month AND a.x BETWEEN 0 AND 1
          AND b.x BETWEEN 0 AND 1 AND abs(abs(a.x-b.x)*100-abs(rn.x)) <= tol) AS apart FROM rn),
      miss AS (SELECT channel, loan_month, raw || unit AS w, min(pos) AS pos FROM hit
        WHERE NOT near AND NOT apart GROUP BY ALL)"""


# ---------------------------------------------------------------- run records

TOOLS = [
    "run_sql",
    "segment_compare",
    "shap_compare",
    "model_score_summary",
    "model_performance",
    "data_quality_check",
]
# invented: tokens per kind at so much a million
PRICES = {
    "BUILDING": {"input": 3.25, "output": 17.5},
    "MACHINERY": {"input": 0.75, "output": 2.25},
    "HOUSEHOLD": {"input": 6.5, "output": 0.0},
}
# judge's texts: what is stored, whether it counts as passed, the reason read from it
UNREADABLE = "(JSON 解析失败) "
VERDICTS = [
    ('{"reason": "ok", "passed": true}', True, "ok"),
    ('verdict: {"passed": false, "reason": "missing figure"} end', False, "missing figure"),
    ("passed: true, but not as an object", True, None),
    ("no verdict {", False, None),
    ('{"passed": "false"}', True, ""),
    ('{"passed": "0", "reason": "text"}', True, "text"),
    ('{"passed": ""}', False, ""),
    ("{'passed': true}", False, None),
    ('{"passed": false} then {"passed": true}', True, None),
    ('{"passed": true', True, None),
    ('{"passed": 0}', False, ""),
    ('{"passed": 0.5, "reason": "half"}', True, "half"),
    ('{"passed": null}', False, ""),
    ('{"passed": []}', False, ""),
    ('{"passed": [0]}', True, ""),
    ('{"reason": "no field"}', False, "no field"),
]
SYSTEMS = ["baseline", "agent_norag", "agent"]


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answered question per account, some with planted errors."""
    u, word = F.col("user_id"), F.lower("channel")
    off = F.when(u % 7 == 0, 0.02).otherwise(0.0)
    shown = F.col("risk_score") + off
    text = F.concat(
        F.lit("客户 "),
        u.cast("string"),
        F.lit("：渠道 "),
        F.when(u % 11 == 0, F.lit("未知")).otherwise(word),
        F.lit("，风险分 "),
        fixed_text(shown, 4),
        F.lit("，违约概率 "),
        fixed_text(shown * 100, 2),
        F.lit("%，额度 "),
        fixed_text(F.col("credit_limit") * F.when(u % 13 == 0, 1.05).otherwise(1.0), 2),
    )
    verdict = F.get(F.lit([text for text, _, _ in VERDICTS]), (u % len(VERDICTS)).cast("int"))

    def check(kind: str, value=None, number: str = None, any_=None, judged=None):
        return F.struct(
            F.lit(kind).alias("type"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
            F.lit(number).cast("string").alias("kind"),
            (F.lit(None) if any_ is None else any_).cast("array<string>").alias("any"),
            (F.lit(None) if judged is None else judged).cast("string").alias("judgement"),
        )

    checks = F.array(
        check("number", F.col("risk_score"), "score"),
        check("number", F.col("risk_score"), "rate"),
        check("number", F.col("credit_limit"), "abs"),
        check("contains", any_=F.array(F.col("channel"), F.col("city_tier"))),
        check("judge", judged=verdict),
    )
    steps = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit("tool_result").alias("kind"),
                    F.lit(tool).alias("tool"),
                    (F.col(f"pay_status_{i}") == 2).alias("is_error"),
                    (F.col(f"bill_amt_{i}") / 1000).alias("elapsed"),
                )
                for i, tool in enumerate(TOOLS, 1)
            ]
        ),
        lambda s: s["elapsed"].isNotNull(),
    )
    ok = F.col("order_status") != "P"
    return obs(spark, folder).select(
        F.concat(F.lit("Q"), u.cast("string")).alias("id"),
        F.substring(F.lit("ABCDE"), F.col("education"), F.lit(1)).alias("category"),
        F.concat(F.lit("客户 "), u.cast("string"), F.lit(" 的风险如何？")).alias("question"),
        F.get(F.array(*[F.lit(s) for s in SYSTEMS]), F.least("marriage", F.lit(2))).alias("system"),
        F.col("channel").alias("model"),
        F.when(ok, text).otherwise("").alias("answer"),
        F.when(F.col("order_status") == "F", "ok")
        .when(ok, "step_limit")
        .otherwise("api_error")
        .alias("status"),
        checks.alias("checks"),
        steps.alias("steps"),
        F.create_map(
            F.lit("input"),
            F.floor("credit_limit").cast("bigint"),
            F.lit("output"),
            (u % 1000).cast("bigint"),
        ).alias("usage"),
        F.round(F.col("credit_limit") / 1000, 3).alias("elapsed"),
        u.alias("seq"),
    )


SUMMARY_COLUMNS = ["system", "model", "usage", "success", "executed", "elapsed", "n_tool_calls"]


def records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of graded answers, stored once as results are before they are summarised."""
    graded = G.grade(answers(spark, folder))
    return T.stored(graded.withColumn("n_tool_calls", F.size("steps")).select(*columns))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES.items()), "model string, price map<string,double>")


def _text_sql(text: str) -> str:
    quoted = text.replace("'", "''")
    return f"'{quoted}'"


def _answers_sql() -> str:
    shown = "(risk_score + CASE WHEN user_id % 7 = 0 THEN 0.02 ELSE 0.0 END)"
    limit = "credit_limit * CASE WHEN user_id % 13 = 0 THEN 1.05 ELSE 1.0 END"
    near = "abs(abs(x)-abs(risk_score))"
    notes = [
        "'期望数值 ' || risk_score",
        "'期望数值 ' || risk_score",
        "'期望数值 ' || credit_limit",
        "'期望包含 [''' || channel || ''', ''' || city_tier || ''']'",
        f"CASE user_id % {len(VERDICTS)}"
        + "".join(
            f" WHEN {i} THEN {_text_sql(UNREADABLE + t if r is None else r)}"
            for i, (t, _, r) in enumerate(VERDICTS)
        )
        + " END",
    ]
    steps = " UNION ALL ".join(
        f"SELECT user_id, '{tool}' AS tool, pay_status_{i} = 2 AS is_error,"
        f" bill_amt_{i}/1000 AS elapsed FROM v WHERE bill_amt_{i} IS NOT NULL"
        for i, tool in enumerate(TOOLS, 1)
    )
    price = "CASE model" + "".join(
        f" WHEN '{m}' THEN (i*{p['input']}+o*{p['output']})/1e6" for m, p in PRICES.items()
    )
    return f"""ans AS (SELECT *, substr('ABCDE', education, 1) AS category,
        CASE marriage WHEN 0 THEN 'baseline' WHEN 1 THEN 'agent_norag' ELSE 'agent' END AS system,
        channel AS model, order_status <> 'P' AS executed,
        CASE order_status WHEN 'F' THEN 'ok' WHEN 'O' THEN 'step_limit' ELSE 'api_error' END AS status,
        '客户 ' || user_id || '：渠道 ' || CASE WHEN user_id % 11 = 0 THEN '未知' ELSE lower(channel) END
        || '，风险分 ' || {fixed_sql(shown, 4)} || '，违约概率 ' || {fixed_sql(shown + "*100", 2)}
        || '%，额度 ' || {fixed_sql(limit, 2)} AS answer,
        CAST(floor(credit_limit) AS BIGINT) AS i, user_id % 1000 AS o,
        round(credit_limit/1000, 3) AS elapsed FROM v),
      an1 AS (SELECT user_id, {_numbers_sql("answer", LEAD, "%|％")} FROM ans WHERE executed),
      an2 AS (SELECT user_id, unnest(raws) AS raw, unnest(units) AS unit FROM an1),
      an AS (SELECT user_id, CAST(replace(raw, ',', '') AS DOUBLE) AS x, unit = '' AS plain FROM an2),
      found AS (SELECT user_id,
        bool_or(plain AND abs(x-risk_score) <= 0.006) AS k1,
        bool_or(abs(abs(x)-abs(risk_score)*100) <= 0.15 OR (plain AND {near} <= 0.0015)) AS k2,
        bool_or(abs(x-credit_limit) <= greatest(0.5, 0.01*abs(credit_limit))) AS k3
        FROM an JOIN v USING (user_id) GROUP BY 1),
      chk AS (SELECT a.*, k1, k2, k3, contains(lower(answer), lower(channel))
          OR contains(lower(answer), lower(city_tier)) AS k4, a.user_id % {len(VERDICTS)} IN ({', '.join(str(i) for i, v in enumerate(VERDICTS) if v[1])}) AS k5
        FROM ans a LEFT JOIN found USING (user_id)),
      graded AS (SELECT *, executed AND k1 AND k2 AND k3 AND k4 AND k5 AS success,
        {price} ELSE 0 END AS cost,
        CASE WHEN NOT executed THEN status ELSE coalesce(nullif(concat_ws('; ',
          {", ".join(f"CASE WHEN NOT k{i} THEN {n} END" for i, n in enumerate(notes, 1))}), ''), status) END AS why
        FROM chk),
      st AS ({steps}),
      calls AS (SELECT user_id, count(*) AS n_tool_calls,
        count(*) FILTER (is_error) AS n_tool_errors FROM st GROUP BY 1),
      rec AS (SELECT g.*, coalesce(n_tool_calls, 0) AS n_tool_calls,
        coalesce(n_tool_errors, 0) AS n_tool_errors FROM graded g LEFT JOIN calls USING (user_id))"""


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    """First answers, and a second attempt for those that did not run."""
    first = answers(spark, folder).select("id", "status")
    again = first.where("status <> 'ok'").select(
        "id", F.lit("retried").alias("status"), F.lit(2).alias("attempt")
    )
    return first.select("id", "status", F.lit(1).alias("attempt")).unionByName(again)


RESULT_SCHEMA = "id string, status string, elapsed double"


def _resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Store the finished answers, then append all: the stored ones stay as they are."""
    path = shared_folder(spark)
    new = answers(spark, folder).select("id", "status", "elapsed")
    done = new.where("status = 'ok'").withColumn("status", F.lit("kept"))
    T.append_new(done, path, "id", RESULT_SCHEMA)
    T.append_new(new, path, "id", RESULT_SCHEMA)
    return T.read_json_lines(spark, path, RESULT_SCHEMA)


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table from a sheet with raw headings, written and read back."""
    back = {new: old for old, new in T.RAW_HEADINGS.items()}
    raw = loans(spark, folder).withColumnsRenamed(back)
    path = shared_folder(spark)
    T.write_loans(T.canonical(raw), path)
    return T.read_table(spark, path)


def _score_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Both score tables written twice and read back: the second write replaces the first."""
    path, view = shared_folder(spark), obs(spark, folder)
    for _ in range(2):
        T.write_scores(view, attributions(view), path)
    kept = T.read_table(spark, f"{path}/risk_scores")
    long = T.read_table(spark, f"{path}/shap_values")
    return kept.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("total")
    ).unionByName(
        long.groupBy(F.col("feature").alias("dataset")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.abs("shap_value")).alias("total")
        )
    )


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    per = M.auc_ks(obs(spark, folder), ["dataset"])

    def of(split: str, column: str):
        return F.max(F.when(F.col("dataset") == split, F.col(column)))

    row = per.agg(
        F.round(of("test", "auc"), 4).alias("test_auc"),
        F.round(of("test", "ks"), 4).alias("test_ks"),
        F.round(of("train", "auc"), 4).alias("train_auc"),
        *[of(split, "n").alias(f"n_{split}") for split in ("train", "valid", "test")],
    )
    T.write_metrics(row, path)
    return T.read_metrics(spark, path)


def _user_sql(spark: SparkSession, folder: str) -> DataFrame:
    view = obs(spark, folder)
    names = {"loans": loans(spark, folder), "risk_scores": scores(spark, folder)}
    names["shap_values"] = attributions(view)
    return T.run_sql(
        spark,
        """SELECT l.channel, count(*) AS n, avg(r.risk_score) AS avg_score, sum(s.total) AS total
        FROM loans l JOIN risk_scores r USING (user_id)
        JOIN (SELECT user_id, sum(shap_value) AS total FROM shap_values GROUP BY user_id) s
        USING (user_id) WHERE l.loan_month NOT IN ('1995-01') GROUP BY l.channel""",
        names,
    )


def register() -> None:
    grounded = (OBS_SQL, _reports_sql(), _grounding_sql())
    add(
        "evidence_numbers",
        "G1 U2",
        "channel, loan_month, n_numbers:i, low:4, high:4",
        lambda s, d: reports(s, d)
        .select("channel", "loan_month", E.evidence_numbers(F.col("evidence")).alias("x"))
        .select(
            "channel",
            "loan_month",
            F.size("x").alias("n_numbers"),
            F.array_min("x").alias("low"),
            F.array_max("x").alias("high"),
        ),
        """SELECT channel, loan_month, count(*) AS n_numbers, min(x) AS low, max(x) AS high
        FROM pool GROUP BY 1, 2""",
        grounded,
    )
    add(
        "evidence_numbers_documents",
        "G1 U2",
        "doc_id:i, n_numbers:i",
        lambda s, d: table(s, d, "documents").select(
            "doc_id", F.size(E.evidence_numbers(F.array("text"))).alias("n_numbers")
        ),
        f"""SELECT doc_id, count(DISTINCT x) AS n_numbers FROM (SELECT doc_id, NULL AS x FROM documents
          UNION ALL SELECT doc_id, x FROM en UNION ALL SELECT doc_id, x/100 FROM en WHERE unit = '%')
        GROUP BY doc_id""",
        (
            f"""e1 AS (SELECT doc_id, {_numbers_sql("text", LEAD, "%")} FROM documents),
            e2 AS (SELECT doc_id, unnest(raws) AS raw, unnest(units) AS unit FROM e1),
            en AS (SELECT doc_id, CAST(replace(raw, ',', '') AS DOUBLE) AS x, unit FROM e2)""",
        ),
    )
    add(
        "report_numbers",
        "G2 G3",
        "channel, loan_month, raws, units",
        lambda s, d: reports(s, d)
        .select("channel", "loan_month", E.report_numbers(F.col("report")).alias("x"))
        .select(
            "channel",
            "loan_month",
            F.array_join(F.transform("x", lambda i: i["raw"]), "|").alias("raws"),
            F.array_join(F.transform("x", lambda i: i["unit"]), "|").alias("units"),
        ),
        """SELECT channel, loan_month, string_agg(raw, '|' ORDER BY pos) AS raws,
          string_agg(unit, '|' ORDER BY pos) AS units FROM rn GROUP BY 1, 2""",
        grounded,
    )
    add(
        "ungrounded_numbers",
        "G4 G5 J8 J9 W6",
        "channel, loan_month, missing",
        lambda s, d: E.ungrounded(reports(s, d), "report", "evidence").select(
            "channel", "loan_month", F.array_join("ungrounded", "|").alias("missing")
        ),
        """SELECT r.channel, r.loan_month, coalesce(string_agg(w, '|' ORDER BY pos), '') AS missing
        FROM rep r LEFT JOIN miss m ON r.channel = m.channel AND r.loan_month = m.loan_month
        GROUP BY 1, 2""",
        grounded,
    )
    from shiftlens.plans.text_queries import MARKDOWN_SQL, _sections_sql, markdown

    def grounded_documents(s, d):
        """How many numbers of a document's later sections its first one does not hold."""
        sections = split_sections(markdown(s, d))
        first = F.min("part").over(Window.partitionBy("doc"))
        placed = sections.withColumn("head", F.col("part") == first)
        # only numbers are stored, so that texts are split and searched once
        found = T.stored(
            placed.select(
                "doc",
                "part",
                F.when(F.col("head"), E.evidence_numbers(F.array("text"))).alias("held"),
                F.when(~F.col("head"), E.report_numbers(F.col("text"))).alias("numbers"),
            )
        )
        pool = found.select("doc", F.explode("held").alias("value"))
        items = found.select("doc", "part", F.posexplode("numbers").alias("at", "x")).select("doc", "part", "at", "x.*")
        missing = E.banded(items, pool, ["doc"]).groupBy("doc").agg(F.count(F.lit(1)).alias("n_missing"))
        return items.groupBy("doc").agg(F.count(F.lit(1)).alias("n_numbers")).join(
            missing, "doc", "left"
        ).select("doc", "n_numbers", F.coalesce("n_missing", F.lit(0)).alias("n_missing"))

    clean = _clean_sql("text")
    add(
        "grounded_documents",
        "J9 G4 G5",
        "doc:i, n_numbers:i, n_missing:i",
        grounded_documents,
        """SELECT doc, count(*) AS n_numbers, count(*) FILTER (NOT EXISTS (SELECT 1 FROM gp
            WHERE gp.doc = gi.doc AND (abs(abs(gp.x) - abs(gi.x)) <= tol
              OR (unit <> '' AND abs(abs(gp.x * 100) - abs(gi.x)) <= tol)))) AS n_missing
        FROM gi GROUP BY 1""",
        (
            _sections_sql(MARKDOWN_SQL),
            "placed AS (SELECT *, part = min(part) OVER (PARTITION BY doc) AS head FROM sections)",
            f"g1 AS (SELECT doc, {_numbers_sql('text', LEAD, '%')} FROM placed WHERE head)",
            "g2 AS (SELECT doc, unnest(raws) AS raw, unnest(units) AS unit FROM g1)",
            "g3 AS (SELECT doc, CAST(replace(raw, ',', '') AS DOUBLE) AS x, unit FROM g2)",
            "gp AS (SELECT doc, x FROM g3 UNION ALL SELECT doc, x / 100 FROM g3 WHERE unit = '%')",
            f"""h1 AS (SELECT doc, {_numbers_sql(clean, LEAD_REPORT, "%|％|pp|个百分点|百分点")}
              FROM placed WHERE NOT head)""",
            "h2 AS (SELECT doc, unnest(raws) AS raw, unnest(units) AS unit FROM h1)",
            """h3 AS (SELECT *, CAST(replace(raw, ',', '') AS DOUBLE) AS x,
              0.5*pow(10.0, -len(string_split(raw || '.', '.')[2])) + 1e-9 AS tol FROM h2)""",
            """gi AS (SELECT * FROM h3 WHERE unit <> ''
              OR abs(x) NOT IN (0,1,2,3,4,5,6,7,8,9,10,12,100,300,2025))""",
        ),
    )
    add(
        "rate_differences",
        "J8",
        "channel, loan_month, n_rates:i, max_diff:4",
        lambda s, d: E.rate_differences(reports(s, d), ["channel", "loan_month"], "evidence"),
        """SELECT channel, loan_month, count(*) AS n_rates, max(x)-min(x) AS max_diff FROM pool
        WHERE x BETWEEN 0 AND 1 GROUP BY 1, 2""",
        grounded,
    )

    run = (OBS_SQL, _answers_sql())
    add(
        "answer_numbers",
        "G6",
        "id, raws, units",
        lambda s, d: answers(s, d)
        .where("status <> 'api_error'")
        .select("id", numbers(F.col("answer"), ANSWER_NUMBER).alias("x"))
        .select(
            "id",
            F.array_join(F.transform("x", lambda i: i["raw"]), "|").alias("raws"),
            F.array_join(F.transform("x", lambda i: i["unit"]), "|").alias("units"),
        ),
        """SELECT 'Q' || user_id AS id, array_to_string(raws, '|') AS raws,
          array_to_string(units, '|') AS units FROM an1""",
        run,
    )
    add(
        "graded_answers",
        "G6 G7 G8 G9 J9",
        "id, executed, success, k1, k2, k3, k4, k5",
        lambda s, d: G.grade(answers(s, d)).select(
            "id",
            *[F.col(c).cast("string").alias(c) for c in ("executed", "success")],
            *[
                F.coalesce(F.get("grade.checks", F.lit(i))["passed"], F.lit(False))
                .cast("string")
                .alias(f"k{i + 1}")
                for i in range(5)
            ],
        ),
        "SELECT 'Q' || user_id AS id, CAST(executed AS VARCHAR) AS executed,"
        " CAST(coalesce(success, FALSE) AS VARCHAR) AS success, "
        + ", ".join(f"CAST(coalesce(executed AND k{i}, FALSE) AS VARCHAR) AS k{i}" for i in range(1, 6))
        + " FROM rec",
        run,
    )
    add(
        "judgements",
        "G8",
        "verdict, passed, reason, n:i",
        lambda s, d: answers(s, d)
        .select(F.col("checks")[4]["judgement"].alias("verdict"))
        .select("verdict", G.judgement(F.col("verdict")).alias("j"))
        .groupBy("verdict", F.col("j.passed").cast("string").alias("passed"), "j.reason")
        .agg(F.count(F.lit(1)).alias("n")),
        "SELECT verdict, passed, reason, count(*) AS n FROM v JOIN (VALUES "
        + ", ".join(
            f"({i}, {_text_sql(t)}, '{str(p).lower()}', {_text_sql(UNREADABLE + t if r is None else r)})"
            for i, (t, p, r) in enumerate(VERDICTS)
        )
        + f") t(k, verdict, passed, reason) ON user_id % {len(VERDICTS)} = k GROUP BY 1, 2, 3",
    )
    add(
        "check_pass_rates",
        "G9",
        "type, n:i, n_passed:i",
        lambda s, d: G.check_pass_rates(G.grade(answers(s, d))),
        """SELECT type, count(*) AS n, count(*) FILTER (k) AS n_passed FROM (
          SELECT 'number' AS type, k1 AS k FROM rec WHERE executed
          UNION ALL SELECT 'number', k2 FROM rec WHERE executed
          UNION ALL SELECT 'number', k3 FROM rec WHERE executed
          UNION ALL SELECT 'contains', k4 FROM rec WHERE executed
          UNION ALL SELECT 'judge', k5 FROM rec WHERE executed) GROUP BY 1""",
        run,
    )
    add(
        "latest_attempts",
        "W5",
        "id, status, attempt:i",
        lambda s, d: R.latest(_attempts(s, d), ["id"], "attempt"),
        """SELECT 'Q' || user_id AS id, CASE WHEN status = 'ok' THEN status ELSE 'retried' END AS status,
          CASE WHEN status = 'ok' THEN 1 ELSE 2 END AS attempt FROM ans""",
        run,
    )
    add(
        "pending_questions",
        "J6",
        "id, category",
        lambda s, d: R.pending(
            answers(s, d).select("id", "category"), answers(s, d).where("status = 'ok'"), ["id"]
        ),
        "SELECT 'Q' || user_id AS id, category FROM ans WHERE status <> 'ok'",
        run,
    )
    add(
        "first_questions",
        "L6",
        "id, category",
        lambda s, d: R.requested(
            answers(s, d).select("id", "category"), answers(s, d).where("model = 'BUILDING'"), first=20
        ),
        """SELECT 'Q' || user_id AS id, category FROM ans WHERE model = 'BUILDING'
        ORDER BY id LIMIT 20""",
        run,
    )
    add(
        "requested_questions",
        "J7",
        "id, category",
        lambda s, d: R.requested(
            answers(s, d).select("id", "category"), answers(s, d).where("model = 'BUILDING'")
        ),
        "SELECT 'Q' || user_id AS id, category FROM ans WHERE model = 'BUILDING'",
        run,
    )
    add(
        "answer_costs",
        "G13 J10",
        "id, cost:6",
        lambda s, d: R.with_cost(answers(s, d), prices(s)),
        "SELECT 'Q' || user_id AS id, cost FROM rec",
        run,
    )
    add(
        "system_summary",
        "G10 A18 A13",
        "system, n:i, success_rate:6, completion_rate:6, avg_elapsed:6, p90_elapsed:6,"
        " avg_tool_calls:6, avg_cost:6",
        lambda s, d: R.system_summary(
            R.with_cost(records(s, d, *SUMMARY_COLUMNS), prices(s))
        ),
        """SELECT system, count(*) AS n, avg(CAST(coalesce(success, FALSE) AS INT)) AS success_rate,
          avg(CAST(executed AS INT)) AS completion_rate, avg(elapsed) AS avg_elapsed,
          quantile_cont(elapsed, 0.9) AS p90_elapsed, avg(n_tool_calls) AS avg_tool_calls,
          avg(cost) AS avg_cost FROM rec GROUP BY 1""",
        run,
    )
    add(
        "category_matrix",
        "G11 A19",
        "category, baseline, agent_norag, agent",
        lambda s, d: R.category_matrix(G.grade(answers(s, d)), SYSTEMS),
        "SELECT category, "
        + ", ".join(
            f"coalesce(count(*) FILTER (success AND system='{s}') || '/' ||"
            f" nullif(count(*) FILTER (system='{s}'), 0), '-') AS {s}"
            for s in SYSTEMS
        )
        + " FROM rec GROUP BY 1",
        run,
    )
    add(
        "category_success",
        "A19",
        "category, system, k:i, n:i, success_rate:6",
        lambda s, d: R.category_success(G.grade(answers(s, d))),
        """SELECT category, system, count(*) FILTER (success) AS k, count(*) AS n,
          count(*) FILTER (success)/CAST(count(*) AS DOUBLE) AS success_rate FROM rec GROUP BY 1, 2""",
        run,
    )
    add(
        "failures",
        "G12",
        "id, question, why",
        lambda s, d: R.failures(G.grade(answers(s, d))),
        """SELECT 'Q' || user_id AS id, '客户 ' || user_id || ' 的风险如何？' AS question, why
        FROM rec WHERE NOT coalesce(success, FALSE)""",
        run,
    )
    add(
        "tool_usage",
        "G14",
        "tool, n_calls:i, n_errors:i, avg_elapsed:6",
        lambda s, d: R.tool_usage(answers(s, d)),
        """SELECT tool, count(*) AS n_calls, count(*) FILTER (is_error) AS n_errors,
          avg(elapsed) AS avg_elapsed FROM st GROUP BY 1""",
        run,
    )
    add(
        "step_counts",
        "G14",
        "id, n_tool_calls:i, n_tool_errors:i",
        lambda s, d: R.step_counts(answers(s, d)),
        "SELECT 'Q' || user_id AS id, n_tool_calls, n_tool_errors FROM rec",
        run,
    )

    cents = ", ".join(f"bill_amt_{i}:2, pay_amt_{i}:4" for i in range(1, 7))
    statuses = ", ".join(f"pay_status_{i}:0" for i in range(1, 7))
    add(
        "canonical_loans",
        "S1 S2 S4",
        "user_id:i, loan_month, channel, city_tier, credit_limit:2, sex:i, education:i,"
        f" marriage:i, age:i, {statuses}, {cents}, is_bad:i",
        _canonical,
        "SELECT * FROM v",
    )
    add(
        "score_tables",
        "S3",
        "dataset, n:i, total:4",
        _score_tables,
        """SELECT dataset, count(*) AS n, sum(risk_score) AS total FROM v GROUP BY 1
        UNION ALL SELECT feature, count(*), sum(abs(shap_value)) FROM shap GROUP BY 1""",
        (OBS_SQL, SHAP_SQL),
    )
    add(
        "base_view_join",
        "P2 J1",
        "dataset, risk_level, n:i, avg_score:6, bad_rate:6",
        lambda s, d: C.base_view(loans(s, d), scores(s, d))
        .groupBy("dataset", "risk_level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("risk_score").alias("avg_score"),
            F.avg("is_bad").alias("bad_rate"),
        ),
        """SELECT dataset, risk_level, count(*) AS n, avg(risk_score) AS avg_score,
          avg(is_bad) AS bad_rate FROM v GROUP BY 1, 2""",
    )
    add(
        "user_sql",
        "S5 S12 P21",
        "channel, n:i, avg_score:6, total:4",
        _user_sql,
        """SELECT channel, count(*) AS n, avg(risk_score) AS avg_score, sum(total) AS total
        FROM v JOIN (SELECT user_id, sum(shap_value) AS total FROM shap GROUP BY 1) USING (user_id)
        WHERE loan_month NOT IN ('1995-01') GROUP BY 1""",
        (OBS_SQL, SHAP_SQL),
    )
    add(
        "resumed_results",
        "S8 S9 J6",
        "id, status, elapsed:3",
        _resumed,
        """SELECT 'Q' || user_id AS id, CASE WHEN status = 'ok' THEN 'kept' ELSE status END AS status,
          elapsed FROM ans""",
        run,
    )
    add(
        "metrics_record",
        "S10 M10",
        "test_auc:4, test_ks:4, train_auc:4, n_train:i, n_valid:i, n_test:i",
        _metrics,
        f"""SELECT max(auc) FILTER (dataset='test') AS test_auc, max(ks) FILTER (dataset='test') AS test_ks,
          max(auc) FILTER (dataset='train') AS train_auc, max(n) FILTER (dataset='train') AS n_train,
          max(n) FILTER (dataset='valid') AS n_valid, max(n) FILTER (dataset='test') AS n_test
        FROM ({auc_sql("v", by="dataset")})""",
    )
