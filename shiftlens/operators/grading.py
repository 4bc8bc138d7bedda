"""Grading of stored answers against stored checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions.text import ANSWER_NUMBER, numbers

CHECK_TYPE = (
    "array<struct<type:string,value:double,kind:string,any:array<string>,judgement:string>>"
)
# Tolerances per kind of number and the states that count as executed.
RATE_POINTS = 0.15
RATE_PLAIN = 0.0015
SCORE_TOLERANCE = 0.006
ABS_FLOOR, ABS_SHARE = 0.5, 0.01
SCORE_KINDS = ["auc", "psi", "score"]
EXECUTED = ["ok", "step_limit"]


def number_found(found: Column, value: Column, kind: Column) -> Column:
    """Does one of the answer's numbers meet the expected value, by kind of number?"""

    def is_close(x: Column) -> Column:
        plain = x["unit"] == ""
        as_rate = (F.abs(F.abs(x["value"]) - F.abs(value) * 100) <= RATE_POINTS) | (
            plain & (F.abs(F.abs(x["value"]) - F.abs(value)) <= RATE_PLAIN)
        )
        as_score = plain & (F.abs(x["value"] - value) <= SCORE_TOLERANCE)
        slack = F.greatest(F.lit(ABS_FLOOR), F.lit(ABS_SHARE) * F.abs(value))
        as_size = F.abs(x["value"] - value) <= slack
        return (
            F.when(kind == "rate", as_rate)
            .when(kind.isin(SCORE_KINDS), as_score)
            .otherwise(as_size)
        )

    return F.exists(found, is_close)


def contains_any(answer: Column, words: Column) -> Column:
    low = F.lower(answer)
    return F.exists(words, lambda w: F.contains(low, F.lower(w)))


# JSON literals that do not count as passed; of strings only the empty one does not.
FALSE_LITERALS = ["false", "null", "0", "0.0", "-0", "-0.0", "[]", "{}"]


def judgement(text: Column) -> Column:
    """struct<passed, reason> out of a judge's text: its JSON object, else the wording.

    The text from the first to the last brace has to be one JSON object and nothing else, by the
    strict grammar: what is quoted with apostrophes or followed by more text is read as wording.
    """
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    listed = F.try_parse_json(F.concat(F.lit("["), braced, F.lit("]")))

    def read(v: Column) -> Column:
        one = F.try_variant_get(v, "$[1]", "variant").isNull() & F.schema_of_variant(
            F.try_variant_get(v, "$[0]", "variant")
        ).startswith("OBJECT")
        readable = F.coalesce((braced != "") & v.isNotNull() & one, F.lit(False))
        passed = F.try_variant_get(v, "$[0].passed", "variant")
        kind, value = F.schema_of_variant(passed), F.to_json(passed)
        truthy = F.when(kind == "STRING", value != '""').otherwise(~value.isin(FALSE_LITERALS))
        reason = F.try_variant_get(v, "$[0].reason", "string")
        worded = text.rlike(r'(?i)"?passed"?\s*[:：]\s*true')
        return F.struct(
            F.when(readable, F.coalesce(truthy, F.lit(False))).otherwise(worded).alias("passed"),
            F.when(readable, F.coalesce(reason, F.lit("")))
            .otherwise(F.concat(F.lit("(JSON 解析失败) "), text))
            .alias("reason"),
        )

    # one-element transform: parsed once, used several times
    return F.get(F.transform(F.array(listed), read), F.lit(0))


def check_results(checks: Column, answer: Column, found: Column) -> Column:
    """array<struct<type, passed, note>>, one per check."""
    is_rule = ["number", "contains"]

    def with_verdict(c: Column) -> Column:
        judged = F.when(~c["type"].isin(is_rule), judgement(c["judgement"]))
        return F.struct(c.alias("c"), judged.alias("verdict"))

    def result(x: Column) -> Column:
        check = x["c"]
        is_number, is_word = check["type"] == "number", check["type"] == "contains"
        passed = (
            F.when(is_number, number_found(found, check["value"], check["kind"]))
            .when(is_word, contains_any(answer, check["any"]))
            .otherwise(x["verdict"]["passed"])
        )
        note = (
            F.when(is_number, F.concat(F.lit("期望数值 "), check["value"].cast("string")))
            .when(
                is_word,
                F.concat(F.lit("期望包含 ['"), F.array_join(check["any"], "', '"), F.lit("']")),
            )
            .otherwise(x["verdict"]["reason"])
        )
        return F.struct(
            check["type"].alias("type"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
            note.alias("note"),
        )

    return F.transform(F.transform(checks, with_verdict), result)


def grade(answers: DataFrame) -> DataFrame:
    """Add ``executed, grade struct<passed, checks>, success`` to answers with their checks.

    Needs ``answer, status, checks``. An answer that did not execute fails without being checked.
    """
    executed = F.col("status").isin(EXECUTED) & (F.coalesce(F.length("answer"), F.lit(0)) > 0)
    found = answers.withColumn("executed", F.coalesce(executed, F.lit(False))).withColumn(
        "__found", numbers(F.col("answer"), ANSWER_NUMBER)
    )
    results = check_results(F.col("checks"), F.col("answer"), F.col("__found"))
    empty = F.array().cast("array<struct<type:string,passed:boolean,note:string>>")
    # the size test is always true; a second use keeps the parsed numbers out of the lambda, where
    # they would be parsed again for every check
    run = F.col("executed") & (F.size("__found") >= 0)
    graded = found.withColumn("__checks", F.when(run, results).otherwise(empty))
    passed = F.col("executed") & F.forall("__checks", lambda c: c["passed"])
    row = F.struct(passed.alias("passed"), F.col("__checks").alias("checks"))
    # exploded from a list of one, so that a filter on what is graded does not grade every answer again
    return (
        graded.withColumn("__row", F.array(row))
        .withColumn("grade", F.explode_outer("__row"))
        .withColumn("success", F.col("executed") & F.col("grade.passed"))
        .drop("__found", "__checks", "__row")
    )


def check_pass_rates(graded: DataFrame) -> DataFrame:
    """How often each type of check passes."""
    # outer, as an inner one first asks each answer whether there are checks, which grades it again
    return (
        graded.select(F.explode_outer("grade.checks").alias("c"))
        .where("c IS NOT NULL")
        .groupBy(F.col("c.type").alias("type"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("c.passed").alias("n_passed"))
    )
