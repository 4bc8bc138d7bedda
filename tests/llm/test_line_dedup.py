"""Line dedup against a plain version."""

import hashlib
import random

import pytest

from shiftlens.llm import line_dedup, queries

from llm.helpers import DOCS, doc

LONG = "this line is long enough "


def plain(rows):
    blanks = " \t\n\v\f\r"

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blanks))

    held = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if doc_id is None or len(held.get(key(x), ())) < 3 or doc_id == max(held[key(x)])
        ]
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(lines), len(lines) - len(kept), sha))
    return sorted(out, key=repr)


def corpus():
    draw = random.Random(11)
    lines = [LONG + str(i) for i in range(40)] + ["short", "", "  ", "É" * 19, "É" * 20, " " + LONG]
    blanks = ["", " ", "\t", "\r", "\v\f ", "\x1f"]
    texts = []
    for _ in range(300):
        chosen = (draw.choice([str.upper, str, str.title])(draw.choice(lines)) for _ in range(draw.randrange(9)))
        texts.append("\n".join(draw.choice(blanks) + x + draw.choice(blanks) for x in chosen))
    rows = [doc(i, t) for i, t in enumerate(texts)]
    rows += [doc(1000 + i, "common line of a third of all documents\n" + str(i) * 30) for i in range(200)]
    rows += [doc(None, texts[0]), doc(None, None), doc(7, None), doc(8, ""), doc(9, "\n\n"), doc(5, texts[6])]
    rows += [doc(5, texts[5])] * 3  # repeated rows, and other rows of the same document
    rows += [doc(2000, "\n".join(LONG + str(i % 50) for i in range(40_000)) + "\n" + "x" * 300_000)]
    return rows


def test_line_dedup(llm, tables):
    rows = corpus()
    got = queries.op11_line_dedup(llm, tables(documents=(rows, DOCS))).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert queries.op11_line_dedup(llm, tables(documents=([], DOCS))).count() == 0


def test_line_dedup_in_several_passes(llm, tables, monkeypatch):
    """Many small segments, of which few go to the tasks at once, and tasks that hand over often."""
    monkeypatch.setattr(line_dedup, "SMALLEST", 10)
    monkeypatch.setattr(line_dedup, "SEGMENTS", 1 << 20)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 4096)
    monkeypatch.setattr(line_dedup, "FLUSH", 50)
    rows = [r for r in corpus() if r[0] != 2000]
    got = queries.op11_line_dedup(llm, tables(documents=(rows, DOCS))).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_few_lines_are_suspected(llm):
    """All lines of two documents, and some 1 of 70 others."""
    rows = [(i, f"own line number {i} {i:030d}" + ("\n" + LONG if i < 2 else "")) for i in range(70_000)]
    docs = llm.createDataFrame(rows, "doc bigint, text string").selectExpr("doc", "md5(text) AS row", "text")
    layout = line_dedup.Layout(len(rows))
    filters = line_dedup.twice_seen(docs, layout)
    found = [r["doc"] for r in line_dedup._suspects(docs, layout, filters, 0, 20).collect()]
    assert found.count(0) >= 1 and found.count(1) >= 1
    assert len(found) < len(rows) / 35


@pytest.mark.parametrize("slots", [[], [0], [5, 6, 2**28 - 1]])
def test_packed_slots(slots):
    import numpy as np

    packed = line_dedup._packed(np.array(slots, np.uint64))
    assert line_dedup._unpacked(packed).tolist() == slots
