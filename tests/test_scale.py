"""What grows with the input: plans and rows that larger tables would multiply."""

from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from shiftlens.functions.text import strip
from shiftlens.operators import grading as G, retrieval as R, runs, term_scores as S
from shiftlens.plans import load


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sections_split_once_and_leave_the_text_behind(spark):
    docs = spark.createDataFrame([(1, "# T\n\nlead\n## A　\nx \n## \x85B"), (2, None), (3, ""), (4, "#  \n## C")], "doc bigint, text string")
    found = R.split_sections(docs)
    assert plan(found).count("split(") == 1
    assert "posexplode(__parts" in plan(found) and "posexplode(split" not in plan(found)
    rows = [tuple(r) for r in found.orderBy("doc", "part").collect()]
    assert rows == [
        (1, 0, "概述", "【T】\nlead"),
        (1, 1, "A", "【T / A】\n## A　\nx"),
        (1, 2, "", "【T / 】\n## \x85B"),
        (4, 0, "概述", "【## C】\n#"),
        (4, 1, "C", "【## C / C】\n## C"),
    ]


def test_strip_takes_all_blanks_at_both_ends(spark):
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    row = spark.createDataFrame([(blanks + "a" + blanks + "b" + blanks, blanks, "​")], "x string, y string, z string")
    got = row.select(*[strip(F.col(c)).alias(c) for c in "xyz"]).first()
    assert tuple(got) == ("a" + blanks + "b", "", "​")


def test_scores_of_pairs_are_not_exchanged(spark):
    chunks = spark.range(4000).selectExpr("id AS chunk_id", "array('a', 'b', 'c' || id % 50) AS terms")
    asked = spark.createDataFrame([(q, ["a", "b", f"c{q}"]) for q in range(20)], "query_id bigint, terms array<string>")
    pairs = R.bm25(chunks, asked)
    assert "Join" not in plan(pairs) and "Aggregate" not in plan(pairs)
    assert pairs.count() == 4000 * 20
    # what is sent on follows the queries, the depth and the tasks, not the pairs
    sent = S.leading(chunks.coalesce(2), *R.asked_terms(chunks, asked), 5)
    assert sent.count() < 20 * 2 * 400
    first = {r["query_id"]: r["ids"] for r in sent.groupBy("query_id").agg(
        F.expr("slice(transform(array_sort(collect_list(struct(-sparse AS s, chunk_id))), x -> x.chunk_id), 1, 5) AS ids")).collect()}
    assert first == {q: [q + 50 * i for i in range(5)] for q in range(20)}


def test_answers_are_graded_once(spark):
    check = "struct<type:string,value:double,kind:string,any:array<string>,judgement:string>"
    rows = [("a", "q", "0.5", "ok", [("number", 0.5, "score", None, None), ("judge", None, None, None, '{"passed": false, "reason": "no"}')]),
            ("b", "q", "", "ok", [("number", 0.5, "score", None, None)]), ("c", "q", "x", "ok", [])]
    answers = spark.createDataFrame(rows, f"id string, question string, answer string, status string, checks array<{check}>")
    rates, failed = G.check_pass_rates(G.grade(answers)), runs.failures(G.grade(answers))
    # once for the numbers and once for their units
    assert plan(rates).count("regexp_extract_all(") == plan(failed).count("regexp_extract_all(") == 2
    assert sorted(map(tuple, rates.collect())) == [("judge", 1, 0), ("number", 1, 1)]
    assert sorted(map(tuple, failed.collect())) == [("a", "q", "no"), ("b", "q", "ok")]


def test_grounding_reads_stored_numbers(spark):
    found = load()["grounded_documents"].run(spark, SMOKE_DIR)
    assert "split(" not in plan(found) and "regexp_extract_all" not in plan(found)
