"""Rules of the secret scan, and the Boolean trigram query that each regex implies."""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

#: Strings that an exact part of a regex may stand for before it is cut.
MAX_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind, its regex, and which group must have how many characters for a match to count."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    either_case: bool = False

    @property
    def pattern(self) -> str:
        return f"(?i){self.regex}" if self.either_case else self.regex


# The base rules, then public formats of keys and tokens.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the maximal runs of 24 and more
)
FORMATS = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", 0, 1, True),
)
RULES = BASE + FORMATS

#: A query: clauses that all must hold; a clause: alternatives, each a set of trigrams that all must occur.
Query = tuple[tuple[frozenset[str], ...], ...]


def trigram_query(regex: str) -> Query:
    """What every text that the regex matches holds, in lower case; () if nothing can be told.

    A walk over the parsed regex keeps the set of strings that the part read last can be, as long as it
    is small. When something open-ended follows, the set is a clause if all its strings have a trigram.
    """
    clauses: list[tuple[frozenset[str], ...]] = []
    for exact in _runs(parser.parse(regex)):
        if exact and all(len(s) >= 3 for s in exact):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
            clauses.append(tuple(sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)))
    return tuple(clauses)


def _runs(seq) -> list[set[str]]:
    runs, current = [], {""}
    for item in seq:
        options, before = _exact(item)
        if options is not None and len(current) * len(options) <= MAX_EXACT:
            current = {a + b for a in current for b in options}
        else:
            runs += [current, *before]
            current = options if options is not None else {""}
    return [*runs, current]


def _exact(item) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that an item can be, or None and the runs that it holds in any case."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()}, []
    if op is C.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, []
        return (chars, []) if len(chars) <= 8 else (None, [])
    if op is C.SUBPATTERN:
        return _whole(arg[3])
    if op is C.BRANCH:
        options: set[str] = set()
        for branch in arg[1]:
            one, _ = _whole(branch)
            if one is None or len(options | one) > MAX_EXACT:
                return None, []
            options |= one
        return options, []
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, sub = arg
        one, inner = _whole(sub)
        if one is not None and high <= 4 and len(one) ** high <= MAX_EXACT:
            options, power = set(), {""}
            for n in range(high + 1):
                options |= power if n >= low else set()
                power = {a + b for a in power for b in one}
            return options, []
        if low == 0:
            return None, []
        return None, inner if one is None else [one]
    return None, []


def _whole(seq) -> tuple[set[str] | None, list[set[str]]]:
    runs = _runs(seq)
    items = [_exact(i)[0] for i in seq]
    size = 1
    for i in items:
        size = size * len(i) if i is not None else MAX_EXACT + 1
    return (runs[-1], []) if size <= MAX_EXACT else (None, runs)
