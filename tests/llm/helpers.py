"""Rows for the operators' tables, with columns that their own names could clash with."""

DOCS = "doc_id bigint, text string, key string, n bigint, spans string, doc string, text_hash string"


def doc(doc_id, text):
    return (doc_id, text, "k", 1, "s", "d", "h")


def numbered(texts):
    return [doc(i, t) for i, t in enumerate(texts)]
