import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from shiftlens.llm import decontaminate, queries

from llm.helpers import DOCS, doc, numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, words string, items string, width int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def plain(text, items):
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        k = min(10, len(w))
        for s in range(len(w) - k + 1) if w and item_id is not None else ():
            for at in range(len(own) - k + 1):
                if own[at : at + k] == w[s : s + k]:
                    hit |= set(range(at, at + k))
                    found.add(str(item_id))
    joined = ",".join(sorted(found))
    return len(own), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


def test_equals_plain_search(llm, tables):
    draw = random.Random(5)
    vocabulary = ["a", "b", "Éa", "ß", "x1", "é", "The", "word"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(1, text(14)), (2, text(30)), (3, "one two three"), (4, "solo"), (5, None), (6, "?!"), (None, "a"),
             (10, text(10)), (3, "one two three"), (7, "Éa b x1 The word")]
    texts = [None, "", "...", items[0][1].upper(), f"pre {items[1][1]}, post", "x ONE-two three; solo", text(400), text(2000)]
    texts += [f"{text(5)} {items[7][1]} {text(5)}" for _ in range(20)]
    rows = numbered(texts) + [doc(4, texts[4]), doc(4, "other"), doc(None, texts[3])]
    folder = tables(documents=(rows, DOCS), benchmark=([(*i, "w", "i", 1) for i in items], ITEMS))
    got = queries.op1_decontaminate(llm, folder)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
    want = [(r[0], *plain(r[1], items)) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = decontaminate.clean(*(llm.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark")))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if not plain(r[1], items)[-1]), key=str)


def test_empty_tables(llm, tables):
    assert queries.op1_decontaminate(llm, tables(documents=([], DOCS), benchmark=([(1, "a", "", "", 1)], ITEMS))).count() == 0
    got = queries.op1_decontaminate(llm, tables(documents=([doc(1, "a b")], DOCS), benchmark=([], ITEMS))).first()
    assert (got["n_words"], got["n_hit"], got["contaminated"]) == (2, 0, False)


def test_blocks_find_the_same(llm, tables, monkeypatch):
    items = [(i, " ".join(f"w{i * 7 + j}" for j in range(12))) for i in range(60)]
    folder = tables(documents=(numbered([t for _, t in items]), DOCS), benchmark=([(*i, "", "", 1) for i in items], ITEMS))
    whole = queries.op1_decontaminate(llm, folder).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8000)
    assert sorted(queries.op1_decontaminate(llm, folder).collect()) == sorted(whole)
    assert all(r["n_items"] >= 1 for r in whole)


def test_words_are_those_of_the_contract_and_found_faster(llm):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[i : i + 4096])) for i in range(0, len(points), 4096)]
    texts += [" ".join(f"{chr(c)}a{chr(c)}" for c in range(1, 0x250))]
    frame = llm.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in frame.select("i", decontaminate.words(F.col("text")).alias("w")).collect():
        assert r["w"] == words(texts[r["i"]])

    line = F.concat(F.lit("Des mots d'été, some words of "), F.col("id").cast("string"))
    prose = llm.range(2000, numPartitions=4).select(F.repeat(line, 200).alias("text"))
    lowered = F.translate("text", decontaminate.UPPER, decontaminate.LOWER)
    plainly = F.regexp_extract_all(lowered, F.lit(WORD.pattern), F.lit(0))

    def seconds(found):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            prose.agg(F.sum(F.size(found))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(decontaminate.words(F.col("text"))) < 0.7 * seconds(plainly)
