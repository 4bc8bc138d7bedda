"""Reading and writing the tables the operators work on."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shiftlens.catalog import LOAN_COLUMNS, RAW_HEADINGS, SCORE_COLUMNS
from shiftlens.session import shared_folder

#: Bytes of small files that a task reads.
GATHERED = 32 << 20

QUESTION_SCHEMA = (
    "id string, category string, question string, "
    "checks array<struct<type:string,value:double,kind:string,any:array<string>,rubric:string>>, "
    "facts string"
)
RUN_SCHEMA = (
    "id string, category string, question string, executed boolean, success boolean, "
    "grade struct<passed:boolean,checks:array<struct<type:string,passed:boolean,note:string>>>, "
    "answer string, status string, model string, "
    "steps array<struct<kind:string,content:string,tool:string,args:map<string,string>,"
    "is_error:boolean,warnings:array<string>,elapsed:double>>, "
    "n_tool_calls int, n_tool_errors int, n_llm_calls int, elapsed double, "
    "usage map<string,bigint>, ungrounded array<string>"
)
METRICS_SCHEMA = (
    "test_auc double, test_ks double, train_auc double, best_iteration int, n_features int, "
    "n_train bigint, n_valid bigint, n_test bigint"
)


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None
) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def canonical(raw: DataFrame) -> DataFrame:
    """Raw headings renamed to the names used here."""
    return raw.withColumnsRenamed(RAW_HEADINGS)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all of them.

    For costly work per row on a small input. A large scan has more splits than cores and is left
    as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def gathered(scan: DataFrame) -> DataFrame:
    """A scan of many small files in tasks of some ``GATHERED`` bytes, four for each core at least.

    Spark counts each file as 4 MB or more, which leaves a handful of small files to a task. No row is exchanged.
    """
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(4 * scan.sparkSession.sparkContext.defaultParallelism, math.ceil(size / GATHERED))
    return scan.coalesce(tasks)


def stored(df: DataFrame, **options: str | int) -> DataFrame:
    """The frame written to the shared folder and read back; ``options`` are the writer's.

    For results that an iterative job reads again and again: it survives the loss of executors and
    what follows no longer depends on how it was computed.
    """
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_loans(df: DataFrame, path: str) -> None:
    """Replace the fact table with its fixed columns in their fixed order."""
    write_table(df.select(*LOAN_COLUMNS), path)


def write_scores(scores: DataFrame, shap_long: DataFrame, folder: str) -> None:
    """Replace both score tables."""
    write_table(scores.select("user_id", *SCORE_COLUMNS), f"{folder}/risk_scores")
    write_table(shap_long.select("user_id", "feature", "shap_value"), f"{folder}/shap_values")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Where a line that does not fit its schema is kept as it was.
UNREADABLE = "unreadable"


def read_checked_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested records of JSON lines, and ``unreadable`` with the lines that are none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE}
    row = F.from_json("value", f"{schema}, {UNREADABLE} string", options)
    return spark.read.text(path).where(F.trim("value") != "").select(row.alias("r")).select("r.*")


def read_sheet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A raw sheet as comma-separated lines with its headings in the second row of each file.

    The first row names groups of columns. Columns are found by their heading, renamed, and read as
    the types of ``schema``; columns that the sheet lacks are null. A line whose values do not fit goes to
    ``unreadable`` whole.
    """
    lines = spark.read.text(path)
    # two lines of one file: the headings are the same in all
    groups, headings = [r["value"] for r in lines.head(2)]
    names = [RAW_HEADINGS.get(h.strip().strip('"'), h.strip().strip('"')) for h in headings.split(",")]
    kinds = {f.name: f.dataType for f in schema}
    typed = ", ".join(f"`{n}` {kinds[n].simpleString() if n in kinds else 'string'}" for n in names)
    body = lines.where(~F.col("value").isin(groups, headings) & (F.trim("value") != ""))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE}
    row = F.from_csv("value", f"{typed}, {UNREADABLE} string", options)
    parsed = body.select("value", row.alias("r"))
    bad = F.col(f"r.{UNREADABLE}").isNotNull()
    columns = [
        F.when(~bad, F.col(f"r.{f.name}")) if f.name in names else F.lit(None).cast(f.dataType)
        for f in schema
    ]
    return parsed.select(
        *[c.alias(f.name) for c, f in zip(columns, schema)],
        F.when(bad, F.col("value")).alias(UNREADABLE),
    )


def unreadable_findings(rows: DataFrame, source: str) -> DataFrame:
    """A finding if there are lines that could not be read."""
    return rows.agg(F.count(UNREADABLE).alias("value")).where("value > 0").select(
        F.lit("unreadable_lines").alias("check_name"),
        F.lit(source).alias("subject"),
        F.lit("error").alias("severity"),
        F.col("value").cast("double").alias("value"),
    )


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored JSON lines, or no rows where nothing has been stored."""
    try:
        return read_json_lines(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(records: DataFrame, path: str, key: str, schema: str) -> None:
    """Append the records whose key is not stored yet; of new ones that repeat a key, one."""
    done = read_if_there(records.sparkSession, path, schema).select(key)
    new = records.join(done, key, "left_anti")
    rest = F.struct(*[c for c in records.columns if c != key])
    once = new.groupBy(key).agg(F.any_value(rest).alias("__r")).select(key, "__r.*")
    once.select(*records.columns).write.mode("append").json(path)


def write_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, METRICS_SCHEMA)


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A user's SELECT over named frames."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:  # the result is resolved already and no longer needs the names
        for name in tables:
            spark.catalog.dropTempView(name)
