"""Base spans against a plain reading of the rules, and the added spans' contract."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shiftlens.llm import pii, queries

from llm.helpers import DOCS, doc

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def random_texts(n):
    draw = random.Random(3)
    parts = (
        "a@b.c _d@e.f x.y+z@m-n.org @ . 1.2.3.4 255.255.255.255 256.1.1.1 0001.2.3.4 4111111111111111 "
        "4111-1111-1111-1111 4111 1111 +1 (319) 555-0132 +49.30 +1 ++ ( ) - é 😀 ü@x.de 5 12345678901234567 "
        "a@b.c.d.e 1.2.3.4.5.6.7.8 ssn 123-45-6789 mail:"
    ).split(" ")
    return ["".join(draw.choice(parts) + draw.choice(["", "", " ", "\n"]) for _ in range(draw.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def found(tables, llm):
    texts = [None, "", *random_texts(600), "9" * 30_000 + "@" + "a" * 30_000, "a." * 20_000, "1.2.3.4 " * 300]
    folder = tables(documents=([doc(i, t) for i, t in enumerate(texts)] + [doc(None, "1.2.3.4"), doc(2, texts[2])], DOCS))
    return texts, queries.op6_pii(llm, folder).collect()


def test_base_spans_equal_the_rules(found):
    texts, rows = found
    assert len(rows) == len(texts) + 2
    for row in rows:
        text = texts[row["doc_id"]] if row["doc_id"] is not None else "1.2.3.4"
        want = plain(text)
        for kind in RULES:
            assert row[f"n_{kind}"] == sum(s[0] == kind for s in want), text[:200]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text[:200]
        assert row["spans"].startswith(joined)


def test_added_spans_keep_off_the_base(found):
    texts, rows = found
    for row in rows:
        spans = [s.split(":") for s in filter(None, row["spans"].split(","))]
        base = [(int(a), int(b)) for k, a, b in spans if k in RULES]
        for kind, a, b in spans:
            if kind not in RULES:
                assert kind in pii.LOOSE
                assert not any(x < int(b) and y > int(a) for x, y in base)


def test_empty_tables(tables, llm):
    assert queries.op6_pii(llm, tables(documents=([], DOCS))).count() == 0


def test_plan_has_no_python(llm, tables):
    folder = tables(documents=([doc(1, "call +1 (319) 555-0132")], DOCS))
    plan = queries.op6_pii(llm, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_every_document_counts_in_the_fit(llm):
    """Those that a sample of 4,000 by the hash of ids would leave out hold the only negatives."""
    ids = llm.range(4300).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    rows = [(i, "at 1.2.3.4 and" if k < 4000 else "no 555-123-4567 here") for k, i in enumerate(ids)]
    model = pii.fit(llm.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert model is not None and model.trees
