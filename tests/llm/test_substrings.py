import hashlib
import random

from shiftlens.llm import queries, substrings

from llm.helpers import DOCS, doc, numbered


def plain(rows):
    """Rows of (doc_id, text) -> (doc_id, n_words, n_removed, sha) by a table of all windows."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - 49) if i is not None else ():
            key = tuple(w[s : s + 50])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[s : s + 50])] < i:
                gone |= set(range(s, s + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_equals_table_of_all_windows(llm, tables):
    draw = random.Random(11)
    word = lambda: draw.choice("abcdefgh") + draw.choice("xyz") + str(draw.randrange(40))
    text = lambda n: [word() for _ in range(n)]
    passage, line = text(90), text(12)
    texts = [None, "", "one", " ".join(text(49))]
    for _ in range(60):
        at = draw.randrange(40)
        part = passage[at : at + draw.randrange(45, 60)]
        texts.append(draw.choice([" ", "\n", "\x0b"]).join(text(draw.randrange(60)) + part + text(draw.randrange(60))))
        texts.append(" ".join(text(30) + line + text(30)))  # a common line, with its own surroundings
    texts += [" ".join(passage)] * 15 + [" ".join(["same"] * n) for n in (49, 50, 51, 120, 300)] + [" ".join(["p", "q"] * 80)]
    edited = passage[:70] + ["new"] + passage[71:]
    texts += [" ".join(edited), " ".join(passage + passage), "\xa0".join(passage[:60])]
    draw.shuffle(texts)
    rows = numbered(texts) + [doc(None, " ".join(passage)), doc(5, " ".join(passage)), doc(5, " ".join(passage))]
    got = queries.op3_substrings(llm, tables(documents=(rows, DOCS))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain([r[:2] for r in rows]), key=str)


def test_kept_words_are_texts(llm):
    passage = " ".join(f"w{i}" for i in range(55))
    docs = llm.createDataFrame([(1, passage), (2, f"before {passage} after")], "doc_id bigint, text string")
    got = {r["doc"]: r["kept"] for r in substrings.without_repeats(docs).collect()}
    assert got == {1: passage, 2: "before after"}


def test_empty_table(llm, tables):
    assert queries.op3_substrings(llm, tables(documents=([], DOCS))).count() == 0
