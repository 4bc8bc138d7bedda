"""Each stage against a plain reading of its rule, on what the stage before has kept."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shiftlens.llm import secret_scan, toxicity
from shiftlens.llm.common import kept_aside, table

from llm.test_decontaminate import plain as plain_hits
from llm.test_ngram_join import plain as plain_groups
from llm.test_small_operators import LIBRARY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(llm):
    """Rows before and after each stage."""
    docs = table(llm, FOLDER, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = kept_aside(stage(llm, docs, FOLDER))
        out.append(docs.collect())
    return out


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_toxic_documents_go(llm, steps):
    model = toxicity.train(table(llm, FOLDER, "documents"), table(llm, FOLDER, "labels"))
    assert ids(steps[1]) == {r["doc_id"] for r in steps[0] if toxicity.score(model, r["text"] or "") < 0.5}
    assert set(steps[1]) <= set(steps[0])


def test_one_document_of_each_group_stays(steps):
    groups = plain_groups([(r["doc_id"], r["text"]) for r in steps[1]])
    assert ids(steps[2]) == {g for _, _, g in groups.values()}
    assert set(steps[2]) <= set(steps[1])


def test_benchmark_passages_go(llm, steps):
    items = [tuple(r) for r in table(llm, FOLDER, "benchmark").collect()]
    assert ids(steps[3]) == {r["doc_id"] for r in steps[2] if not plain_hits(r["text"], items)[-1]}
    assert set(steps[3]) <= set(steps[2])


def test_secrets_are_replaced(steps):
    before = {r["doc_id"]: r for r in steps[3]}
    assert ids(steps[4]) == set(before)
    for row in steps[4]:
        old = before[row["doc_id"]]
        assert row["text"] == secret_scan.redact(old["text"]) and row["n_chars"] == len(row["text"])
        assert not [s for s in secret_scan.find(row["text"]) if s[0] != "assign"]
        assert row["source"] == old["source"] and row["lang"] == old["lang"]


def test_ids_equal_the_library(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[4]}
    assert ids(steps[5]) == set(texts)
    for row in steps[5]:
        want = LIBRARY.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["ids"] == want and row["n_tokens"] == len(want)
        assert row["decoded"] == LIBRARY.decode(want, skip_special_tokens=False)


def test_run_is_all_stages(llm, steps):
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(llm, FOLDER).collect()} == {r["doc_id"]: r["ids"] for r in steps[5]}


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


def test_nulls_and_empty_table(llm, tables):
    schema = table(llm, FOLDER, "documents").schema
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", None, 0)]
    labels = ([], "doc_id bigint, quality int, toxic int")
    bench = ([], "item_id bigint, text string")
    folder = tables(documents=(rows, schema), labels=labels, benchmark=bench)
    got = corpus_pipeline.run(llm, folder).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "None"]
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 0, 2: 0, None: 3}
    assert corpus_pipeline.run(llm, tables(documents=([], schema), labels=labels, benchmark=bench)).count() == 0
