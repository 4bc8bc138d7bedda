"""URL rules as one bit-parallel wildcard automaton.

A rule is a glob over ``host`` + ``path``: ``*`` stands for any characters but a slash, ``**`` for
any characters at all, other characters for themselves. All globs are laid end to end into one
multiword Shift-And mask, a bit per glob position; reading one character of a URL shifts the states
of every glob at once, and wildcards are positions that keep their bit. A rule of a host and a path
becomes two globs, one for the host and one for its subdomains.

A null URL, or one without ``://``, has an empty host and path, so only rules that match the empty
string would fit it. Repeated rows are judged alike; equally long rules give way to the earlier.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``name`` is what is reported; the longest name among the rules that fit decides."""

    name: str
    verdict: str
    globs: tuple[str, ...]


def site_rule(verdict: str, site: str) -> Rule:
    """A host with its subdomains, and what its paths begin with: ``example.org/en/1``."""
    return Rule(site, verdict, (f"{site}**", f"*.{site}**"))


# The rules of the query.
RULES = (
    site_rule(ALLOW, "org/"),
    site_rule(BLOCK, "example.org/es/"),
    site_rule(BLOCK, "example.org/en/1"),
    site_rule(ALLOW, "com/fr/"),
    site_rule(BLOCK, "com/de/"),
)

#: The verdict where no rule fits is that of the longest of these that fits, or else ``ALLOW``:
#: files that hold no text, and numbers in place of a name.
METHOD_RULES = (
    Rule("program", BLOCK, ("**.exe", "**.zip", "**.tar.gz", "**.dmg")),
    Rule("picture", BLOCK, ("**.jpg", "**.jpeg", "**.png", "**.gif", "**.svg")),
    Rule("login", BLOCK, ("*/login**", "*/signin**", "*/wp-admin/**")),
)

PARTS = "struct<host:string,path:string,rule:string,verdict:string>"

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """Host, its A-Z in lower case, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].translate(_UPPER), path[:stop]


class Automaton:
    """All globs at once. Bit k of the state: the glob is read up to its position k."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.first = 0  # where globs start
        self.stay_any = 0  # positions that keep their bit on every character
        self.stay_name = 0  # positions that keep their bit on all but a slash
        self.skip = 0  # positions that may be passed without a character
        self.accept: list[tuple[int, int]] = []
        self.moves: dict[str, int] = {}
        at = 0
        for n, rule in enumerate(rules):
            for glob in rule.globs:
                at = self._add(glob, at, n)
        self.empty = self._closed(self.first)

    def _add(self, glob: str, at: int, rule: int) -> int:
        self.first |= 1 << at
        i = 0
        while i < len(glob):
            if glob.startswith("**", i):
                self.stay_any |= 1 << at
                self.skip |= 1 << at
                i += 2
            elif glob[i] == "*":
                self.stay_name |= 1 << at
                self.skip |= 1 << at
                i += 1
            else:
                self.moves[glob[i]] = self.moves.get(glob[i], 0) | 1 << at
                i += 1
            at += 1
        self.accept.append((1 << at, rule))
        return at + 1

    def _closed(self, state: int) -> int:
        """Wildcards may stand for nothing."""
        while True:
            more = state | (state & self.skip) << 1
            if more == state:
                return state
            state = more

    def matching(self, text: str) -> list[Rule]:
        state = self.empty
        for c in text:
            stay = state & (self.stay_any if c == "/" else self.stay_any | self.stay_name)
            state = self._closed(stay | (state & self.moves.get(c, 0)) << 1)
            if not state:
                break
        return [self.rules[n] for n in sorted({n for bit, n in self.accept if state & bit})]


def longest(rules: list[Rule]) -> Rule | None:
    return max(rules, key=lambda r: len(r.name), default=None)


@lru_cache(maxsize=8)
def _automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)


def judge(url: str | None, rules: tuple[Rule, ...], method: tuple[Rule, ...]) -> tuple:
    host, path = parts(url)
    fits = longest(_automaton(rules).matching(host + path))
    if fits:
        return host, path, fits.name, fits.verdict
    other = longest(_automaton(method).matching(host + path))
    return host, path, None, other.verdict if other else ALLOW


def judged(
    url: Column, rules: tuple[Rule, ...] = RULES, method: tuple[Rule, ...] = METHOD_RULES
) -> Column:
    """``host, path, rule, verdict`` of each URL."""

    @F.arrow_udf(PARTS)
    def verdicts(urls: pa.Array) -> pa.Array:
        columns = zip(*(judge(u.as_py(), rules, method) for u in urls), strict=True)
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.string()) for c in columns] or [pa.array([], pa.string())] * 4,
            ["host", "path", "rule", "verdict"],
        )

    return verdicts(url)
