"""The analytic view bound to the order tables: one order stands for one customer account.

Line 1..6 of an order stand for the six latest months; the score is a fixed linear log-odds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftlens.catalog import (
    BILL_COLUMNS,
    LOAN_COLUMNS,
    PAYMENT_COLUMNS,
    STATUS_COLUMNS,
    worst_status,
)
from shiftlens.operators import attribution, monitor

# The terms of the stand-in score.
INTERCEPT = "-1.5d"
TERMS = {
    "max_pay_status": "0.4d * coalesce(max_pay_status, -2)",
    "pay_status_1": "0.3d * coalesce(pay_status_1, -2)",
    "credit_limit": "-0.000004d * (credit_limit - 150000)",
}


# Read with explicit schemas: no footer has to be opened to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def line_slots(lines: DataFrame) -> DataFrame:
    """Status, bill and payment of lines 1..6 per order, summed where a line number repeats."""
    status = "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END"
    slots = []
    for i in range(1, 7):
        here = f"l_linenumber = {i}"
        slots += [
            f"coalesce(max({status}) FILTER (WHERE {here}), -2) AS pay_status_{i}",
            f"sum(l_extendedprice) FILTER (WHERE {here}) AS bill_amt_{i}",
            f"sum(l_extendedprice * (1 - l_discount)) FILTER (WHERE {here}) AS pay_amt_{i}",
        ]
    return lines.groupBy("l_orderkey").agg(*[F.expr(s) for s in slots])


def terms() -> dict[str, Column]:
    """The score's log-odds terms by feature."""
    return {name: F.expr(term) for name, term in TERMS.items()}


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Fact columns, unrounded score ``p``, rounded score, level and split per order."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    people = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    slots = line_slots(table(spark, folder, "lineitem"))
    joined = (
        orders.join(slots, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("max_pay_status", worst_status())
    )
    facts = joined.selectExpr(
        "o_orderkey AS user_id",
        "date_format(o_orderdate, 'yyyy-MM') AS loan_month",
        "c_mktsegment AS channel",
        "r_name AS city_tier",
        "o_totalprice AS credit_limit",
        "c_nationkey % 2 + 1 AS sex",
        "int(substring(o_orderpriority, 1, 1)) AS education",
        "c_nationkey % 4 AS marriage",
        "int(floor(16 + (c_acctbal + 1000) / 128)) AS age",
        *STATUS_COLUMNS,
        *BILL_COLUMNS,
        *PAYMENT_COLUMNS,
        "int(o_orderstatus = 'F') AS is_bad",
        "c_acctbal AS balance",
        "max_pay_status",
        "o_orderstatus AS order_status",
    )
    odds = f"{INTERCEPT} + " + " + ".join(TERMS.values())
    return facts.withColumn("p", F.expr(f"1d / (1d + exp(-({odds})))")).select(
        "*",
        F.expr("round(p, 4) AS risk_score"),
        monitor.risk_level(F.col("p")).alias("risk_level"),
        F.expr(
            "CASE WHEN user_id % 100 < 64 THEN 'train' WHEN user_id % 100 < 80 THEN 'valid'"
            " ELSE 'test' END AS dataset"
        ),
    )


def loans(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).select(*LOAN_COLUMNS)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).select("user_id", "risk_score", "risk_level", "dataset")


def attributions(view: DataFrame) -> DataFrame:
    """Long attributions of the stand-in score."""
    return attribution.to_long(attribution.linear_attributions(view, terms()), list(terms()))


# ---------------------------------------------------------------- the same view for the oracle


def _slot(i: int) -> str:
    here = f"l_linenumber={i}"
    status = "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END"
    return (
        f"COALESCE(MAX(CASE WHEN {here} THEN {status} END), -2) AS pay_status_{i},"
        f" SUM(CASE WHEN {here} THEN l_extendedprice END) AS bill_amt_{i},"
        f" SUM(CASE WHEN {here} THEN l_extendedprice*(1-l_discount) END) AS pay_amt_{i}"
    )


WORST_SQL = "GREATEST(" + ", ".join(STATUS_COLUMNS) + ")"

OBS_SQL = f"""
li AS (SELECT l_orderkey, {", ".join(_slot(i) for i in range(1, 7))}
  FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT o_orderkey AS user_id, strftime(o_orderdate, '%Y-%m') AS loan_month,
    c_mktsegment AS channel, r_name AS city_tier, o_totalprice AS credit_limit,
    CAST(c_nationkey % 2 + 1 AS INT) AS sex,
    CAST(substr(o_orderpriority, 1, 1) AS INT) AS education,
    CAST(c_nationkey % 4 AS INT) AS marriage,
    CAST(floor(16 + (c_acctbal + 1000) / 128) AS INT) AS age,
    li.* EXCLUDE (l_orderkey), CAST(o_orderstatus = 'F' AS INT) AS is_bad,
    c_acctbal AS balance, {WORST_SQL} AS max_pay_status, o_orderstatus AS order_status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey LEFT JOIN li ON o_orderkey = l_orderkey),
scored AS (
  SELECT *, 1/(1+exp(-(-1.5 + 0.4*COALESCE(max_pay_status,-2) + 0.3*COALESCE(pay_status_1,-2)
    - 0.000004*(credit_limit-150000)))) AS p FROM facts),
v AS (
  SELECT *, round(p, 4) AS risk_score,
    CASE WHEN p >= 0.5 THEN '高' WHEN p >= 0.25 THEN '中' ELSE '低' END AS risk_level,
    CASE WHEN user_id % 100 < 64 THEN 'train' WHEN user_id % 100 < 80 THEN 'valid'
      ELSE 'test' END AS dataset
  FROM scored)"""

SHAP_SQL = """
m AS (SELECT avg(0.4*COALESCE(max_pay_status,-2)) AS m1, avg(0.3*COALESCE(pay_status_1,-2)) AS m2,
  avg(-0.000004*(credit_limit-150000)) AS m3 FROM v),
shap AS (
  SELECT user_id, 'max_pay_status' AS feature, 0.4*COALESCE(max_pay_status,-2) - m1 AS shap_value
  FROM v, m
  UNION ALL SELECT user_id, 'pay_status_1', 0.3*COALESCE(pay_status_1,-2) - m2 FROM v, m
  UNION ALL SELECT user_id, 'credit_limit', -0.000004*(credit_limit-150000) - m3 FROM v, m)"""


def over_view(select: str, *more: str) -> str:
    """Oracle text: ``select`` over the view ``v`` and further CTEs."""
    return "WITH " + ",".join([OBS_SQL, *more]) + "\n" + select
