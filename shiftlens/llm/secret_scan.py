"""Secrets in texts: keyword automaton, anchored expressions near its hits, checksums.

An Aho-Corasick automaton over the keywords of all kinds reads a text once. Only where a keyword
ends is the expression of its kind tried, anchored at the keyword's start. Kinds with a checksum in
the secret itself are kept only if it fits. Long hexadecimal runs have no keyword and are found by
one expression of their own.

Offsets count code points, ends are exclusive. Null and empty texts have no secrets; repeated rows
give the same spans. Within a kind spans never overlap, between kinds they may.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Kinds, keywords and expressions of the base scan.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_CHARS = 6
ACCESS_WORD = "AKIA"
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 20
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")

# Added kinds: prefixes of published token formats whose last six characters are a CRC-32.
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEY_WORD = "-----BEGIN "
# of any length: a body is read once, without a way back
KEY = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s]++-----END \1-----")
KINDS = (*BASE_KINDS, "checked", "key")

DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPAN = "struct<kind:string,start:int,end:int>"


def checksum62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    own = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for cased in itertools.product(*({c, c.upper()} for c in word)):
            own.add_word("".join(cased), ("assign", len(word)))
    own.add_word(ACCESS_WORD, ("access", len(ACCESS_WORD)))
    for word in CHECKED_WORDS:
        own.add_word(word, ("checked", len(word)))
    own.add_word(KEY_WORD, ("key", len(KEY_WORD)))
    own.make_automaton()
    return own


def _keep(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match.group(1)) >= ASSIGN_CHARS
    if kind == "access":
        return len(match.group()) >= ACCESS_CHARS
    if kind == "checked":
        return checksum62(match.group(1)) == match.group(2)
    return True


def find(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` by start, then by kind in the order of ``KINDS``."""
    rules = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED, "key": KEY}
    done = dict.fromkeys(rules, 0)
    out = [("hex", *m.span()) for m in HEX.finditer(text)]
    for last, (kind, width) in _automaton().iter(text):
        start = last + 1 - width
        # "token" inside a match, or a keyword read as part of an earlier one of its kind
        if start < done[kind]:
            continue
        match = rules[kind].match(text, start)
        if match:
            done[kind] = match.end()
            if _keep(kind, match):
                out.append((kind, *match.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def merged(spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Overlapping spans joined under the kind that starts first."""
    held: tuple[str, int, int] | None = None
    for kind, start, end in spans:
        if held and start < held[2]:
            held = (held[0], held[1], max(held[2], end))
        else:
            if held:
                yield held
            held = (kind, start, end)
    if held:
        yield held


def redact(text: str) -> str:
    """The text with every secret replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in merged(find(text)):
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def secret_spans(text: Column) -> Column:
    """All spans of each text."""

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(texts: pa.Array) -> pa.Array:
        own = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        rows = [
            [dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t.as_py() or "")]
            for t in texts
        ]
        return pa.array(rows, pa.list_(own))

    return spans(text)


def redacted(text: Column) -> Column:
    """Each text without its secrets; null stays null."""

    @F.arrow_udf("string")
    def without(texts: pa.Array) -> pa.Array:
        return pa.array([t and redact(t) for t in texts.to_pylist()], pa.string())

    return without(text)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
