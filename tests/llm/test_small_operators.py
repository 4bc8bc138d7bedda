"""URL rules, top-k, token counts, BPE and toxicity against plain versions."""

import hashlib
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftlens.llm import bpe, queries, token_counts, toxicity, url_filter

from llm.helpers import DOCS, doc, numbered

PAGES = "page_id bigint, url string, html string, host string, path string, rule string"
VECTORS = "vec_id bigint, embedding array<float>, label int, ints string, score int"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("#")[0].split("?")[0]
    fits = [
        r for r in url_filter.RULES
        for h, _, p in [r.name.partition("/")]
        if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}")
    ]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_rules(llm, tables):
    draw = random.Random(4)
    parts = ["http", "://", "a.", "example.", "ORG", "org", "com", "net", "/", "fr/", "de/", "es/", "en/1", "?", "#", "x", "é", "org/"]
    urls = [None, "", "no scheme", "x://", "://org/", "ftp://Example.ORG/en/123?q#f", "http://evil.com/x.org/", "http://norg/",
            "http://org:80/", "http://a.b.com/de/" + "z" * 50_000, *("".join(draw.choices(parts, k=9)) for _ in range(3000))]
    rows = [(i, u, None, "h", "p", "r") for i, u in enumerate(urls)] + [(5, urls[5], "", "", "", "")]
    got = queries.op8_url_filter(llm, tables(pages=(rows, PAGES))).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain_verdict(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or rule is None and r["verdict"] in ("allow", "block")
    assert queries.op8_url_filter(llm, tables(pages=([], PAGES))).count() == 0


def plain_top(rows, k=5):
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (q, v) in enumerate(usable):
        if q % 50 == 0:
            others = (x for n, x in enumerate(usable) if n != at and len(x[1]) == len(v))
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in others)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_exact_topk(llm, tables):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=16)], 0, "i", 1) for i in range(600)]
    rows += [(600 + i, [1.0] * 16, 0, "i", 1) for i in range(20)]  # ties, at another length too
    rows += [(1000, None, 0, "", 1), (1050, [None] * 16, 0, "", 1), (1100, [math.nan] * 16, 0, "", 1), (None, [0.5] * 16, 0, "", 1),
             (1150, [math.inf] * 16, 0, "", 1), (1200, [], 0, "", 1), (1250, [0.5, 0.5], 0, "", 1), (1251, [1.0, -1.0], 0, "", 1), rows[7], rows[50]]
    rows += [(50, rows[9][1], 0, "", 1)] + [rows[100]] * 12  # an id with two vectors, and many equal queries
    got = queries.op9_exact_topk(llm, tables(embeddings=(rows, VECTORS)))
    assert sorted(map(tuple, got.collect())) == plain_top(rows)
    assert queries.op9_exact_topk(llm, tables(embeddings=([], VECTORS))).count() == 0


def test_exact_topk_reads_a_block_for_many_queries():
    from shiftlens.llm import exact_topk

    draw = np.random.default_rng(5)
    block = np.floor(256 * draw.normal(size=(500, 12)))
    block[100:120] = block[7]
    own, ids = np.arange(500), draw.permutation(500)
    asked = np.array([0, 7, 100, 499, 250])
    scores = (block @ block[asked].T).T
    scores[np.arange(5), asked] = -np.inf
    want = [np.lexsort((ids, -s))[:5] for s in scores]
    for floors in (np.full(5, -np.inf), np.array([s[w[2]] for s, w in zip(scores, want)])):
        found = exact_topk.Lists(own, ids, block).best(asked, block[asked], 5, floors)
        for (got_ids, got), s, w, floor in zip(found, scores, want, floors):
            n = int((s[w] >= floor).sum())
            assert got_ids[:n].tolist() == ids[w][:n].tolist() and got[:n].tolist() == s[w][:n].tolist()


def test_exact_topk_in_several_passes(llm, tables, monkeypatch):
    from shiftlens.llm import exact_topk

    monkeypatch.setattr(exact_topk, "QUERY_BYTES", 200)
    rows = [(i, [float((i * 7 + j) % 11) for j in range(8)], 0, "", 1) for i in range(300)]
    assert sorted(map(tuple, queries.op9_exact_topk(llm, tables(embeddings=(rows, VECTORS))).collect())) == plain_top(rows)


@pytest.fixture(scope="module")
def pieces():
    return token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))


def plain_count(word, pieces):
    text = token_counts.MARK + word

    @lru_cache(None)
    def best(end):
        if end == 0:
            return 0.0, 0
        n = len(text[end - 1].encode())
        options = [(best(end - 1)[0] + n * token_counts.BYTE_SCORE, best(end - 1)[1] - n)]
        options += [(best(s)[0] + pieces[text[s:end]], best(s)[1] - 1) for s in range(end) if text[s:end] in pieces]
        return max(options)

    return -best(len(text))[1]


def test_token_counts(llm, tables, pieces):
    own = token_counts.Trie(pieces)
    for word in ["a", "hello", "tokenization", "naïve", "日本語", "😀😀", "x" * 200, "hellos", "hell", "Grüße-2024", "\x00"]:
        assert own.count(word) == plain_count(word, pieces) == own.count(word)
    texts = [None, "", " \n", "the quick brown fox", "the quick brown fox", "word " * 20_000]
    got = {r["doc_id"]: r for r in queries.op10_token_counts(llm, tables(documents=(numbered(texts), DOCS))).collect()}
    for i, t in enumerate(texts):
        split = (t or "").split()
        each = {w: plain_count(w, pieces) for w in set(split)}
        assert (got[i]["n_tokens"], got[i]["n_pretokens"]) == (sum(each[w] for w in split), len(split))
    assert queries.op10_token_counts(llm, tables(documents=([], DOCS))).count() == 0


def test_trie_starts_anew(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "TRIE_NODES", 10)
    own = token_counts.Trie(pieces)
    words = ["alpha", "beta", "gamma", "alphabet"] * 3
    assert [own.count(w) for w in words] == [plain_count(w, pieces) for w in words]


PATH = public_tokenizers.path("word_bpe_49k.json")
OWN, LIBRARY = bpe.Tokenizer(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.sampled_from(["a<|endoftext|> B", "ΑΣ it's 12½ ", "İ ſ K", "ཀྵ" * 9, "x" * 400]))
def test_bpe_equals_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_query(llm, tables):
    texts = [None, "", "Hello  World!\n\tit's", "<|startoftext|>abc<|endoftext|>", "long " * 30_000, "Hello"]
    rows = numbered(texts) + [doc(5, "Hello"), doc(None, "x")]
    folder = tables(documents=(rows, DOCS))
    got = sorted(map(tuple, queries.op5_bpe(llm, folder).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        joined = [" ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)]
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in joined)))
    assert got == sorted(want, key=str)
    content = llm.sparkContext.broadcast(bpe.read_vocabulary(PATH))
    full = llm.read.parquet(f"{folder}/documents.parquet").select("text", bpe.encoded(F.col("text"), content).alias("e"))
    for r in full.collect():
        assert r["e"]["ids"] == LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["e"]["decoded"] == LIBRARY.decode(r["e"]["ids"], skip_special_tokens=False)
    assert queries.op5_bpe(llm, tables(documents=([], DOCS))).count() == 0


def test_bpe_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.Tokenizer(bpe.read_vocabulary(PATH))
    text = "one two three four five one two " * 3
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_frequent_words_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.Tokenizer(bpe.read_vocabulary(PATH))
    merged, plain = [], own.encode_word
    monkeypatch.setattr(own, "encode_word", lambda word: merged.append(word) or plain(word))
    text = " ".join(f"often rare{'x' * i}" for i in range(1, 20))
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert merged.count("often") == 1 and len(merged) == 20


def test_bpe_holds_few_ids_and_packed_words(llm, tables, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_IDS", 50)
    own = bpe.Tokenizer(bpe.read_vocabulary(PATH))
    texts = ["one two three " * (i % 5) for i in range(90)] + ["", "long " * 300, None]
    whole = pa.array(texts, pa.string())
    pieces = list(own.lists([whole.slice(0, 40), whole.slice(40, 0), whole.slice(40)]))
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids for piece in pieces for ids in piece.to_pylist()] == want
    assert len(pieces) > 10 and all(len(piece.slice(0, len(piece) - 1).flatten()) < 50 for piece in pieces)
    decoded = [d for piece in pieces for d in own.joined(own.strings, piece).to_pylist()]
    assert decoded == [LIBRARY.decode(ids, skip_special_tokens=False) for ids in want]
    # of a word its ids alone are kept, four bytes each
    assert {w: len(kept) for w, kept in own.known.items()} == {w: 4 * len(own.encode_word(w)) for w in ("one", "two", "three", "long")}


def test_toxicity(llm, tables):
    draw = random.Random(8)
    syllables = ["an", "the", "or", "tion", "es", "in", "ly", "re", "st", "on"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randrange(1, 5)))
    texts, marks = [], []
    for i in range(900):
        own = [word() for _ in range(draw.randrange(40, 120))]
        bad = i % 6 == 0
        for _ in range(8 if bad else 0):
            own[draw.randrange(len(own))] = draw.choice(["wretched", "vermin", "despicable", "lowlife"])
        texts.append(" ".join(own))
        marks.append(int(bad))
    rows = numbered(texts) + [doc(900, None), doc(901, ""), doc(902, texts[1]), doc(None, texts[0]), doc(903, "ok " * 60_000)]
    labels = [(i, 1, m, "") for i, m in enumerate(marks)] + [(0, 1, marks[0], ""), (None, 1, 1, ""), (5, None, None, "")]
    got = queries.op4_toxicity(llm, tables(documents=(rows, DOCS), labels=(labels, LABELS))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in known)
    apart = [r for r in known if r["held_out"]]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in apart) >= 0.95 * len(apart)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[900] == by_id[901] < 0.5 and by_id[902] == by_id[1] and by_id[None] == by_id[0]


def test_toxicity_without_labels(llm, tables):
    folder = tables(documents=([doc(1, "a b")], DOCS), labels=([], LABELS))
    assert [r["score"] for r in queries.op4_toxicity(llm, folder).collect()] == [0.0]
    assert queries.op4_toxicity(llm, tables(documents=([], DOCS), labels=([(1, 1, 1, "")], LABELS))).count() == 0


def test_training_ignores_held_out_labels(llm):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = llm.createDataFrame([(i, "some words here") for i in ids], "doc_id bigint, text string")
    labels = llm.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id bigint, quality int, toxic int")
    assert toxicity.train(docs, labels) == toxicity.Model()


def test_toxic_words_that_some_ordinary_documents_hold():
    draw = random.Random(11)
    syllables = ["an", "the", "or", "tion", "es", "in", "ly", "re", "st", "on"]
    marks = ["wretched", "vermin", "despicable", "lowlife"]

    def text(bad):
        own = ["".join(draw.choices(syllables, k=draw.randrange(1, 5))) for _ in range(60)]
        return " ".join([*own, *(draw.choices(marks, k=6) if bad else [])])

    toxic, ordinary = ([text(bad) for _ in range(n)] for bad, n in ((True, 150), (False, 750)))
    quoted = [text(False) + " " + " ".join(marks) for _ in range(6)]
    model = toxicity.fit(toxic, ordinary + quoted)
    assert all(m.encode() in model.toxic and m.encode() not in model.ordinary for m in marks)
    assert sum(toxicity.score(model, text(True)) >= 0.5 for _ in range(100)) >= 95
    assert sum(toxicity.score(model, text(False)) >= 0.5 for _ in range(100)) <= 5
