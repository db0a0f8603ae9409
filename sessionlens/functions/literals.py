"""An index of literals for many patterns: most patterns can't match a text, as it lacks a word that they need.

From each pattern comes a set of strings one of which every match contains.  A trie
of all of them, as one expression, tells in one pass which ones a text holds; only
patterns with one of theirs are run.  Patterns from which no such set can be
derived always run, so results are the same as without the index.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST = 3
#: Letters that equal i, k and s if case doesn't count, though they aren't their capitals.
FOLDED = ("ſKİı", "skii")


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case strings one of which every match of the pattern (in any case) contains; None if none are known."""
    try:
        return _best(_options(_parser.parse(pattern, re.IGNORECASE)))
    except (re.error, RecursionError):
        return None  # of another dialect


def _best(options: list[frozenset[str]]) -> frozenset[str] | None:
    options = [o for o in options if min(map(len, o)) >= SHORTEST]
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _options(parsed) -> list[frozenset[str]]:
    """Sets of strings, of each of which every match contains one."""
    out, run = [], ""

    def end():
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for op, arg in parsed:
        if op is C.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is C.AT:
            continue  # takes no character
        end()
        if op is C.SUBPATTERN:
            out += _options(arg[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            out += _options(arg[-1])
        elif op is C.BRANCH:
            each = [_best(_options(b)) for b in arg[1]]
            if all(each):
                out.append(frozenset().union(*each))
    end()
    return out


def trie(words: list[str]) -> str:
    """A pattern for the longest of the words that begins at a place; shared beginnings are tried once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + trie(rest) for c, rest in sorted(heads.items())]
    if not parts:
        return ""
    whole = parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})"
    return f"{whole}?" if "" in words else whole


class LiteralIndex:
    """The literals of a set of patterns."""

    def __init__(self, patterns: list[str]):
        self.needs = {p: required(p) for p in patterns}
        self.words = sorted(set().union(*(n for n in self.needs.values() if n)))

    def found(self, text: Column) -> Column:
        """The literals that the text holds, the longest at each place."""
        if not self.words:
            return F.array().cast("array<string>")
        plain = F.lower(F.translate(text, *FOLDED))
        return F.array_distinct(F.regexp_extract_all(plain, F.lit(f"(?s)(?=({trie(self.words)}))"), F.lit(1)))

    def may_match(self, found: Column, patterns: list[str]) -> Column:
        """Whether any of the patterns is to be run at all."""
        if any(self.needs.get(p) is None for p in patterns):
            return F.lit(True)
        words = frozenset().union(*(self.needs[p] for p in patterns))
        # a longer literal at the same place stands for those that it begins with
        return F.arrays_overlap(found, F.array(*(F.lit(w) for w in self.words if w.startswith(tuple(words)))))

    def runs(self, found: Column) -> Column:
        """How many patterns are left to run."""
        out = F.lit(0)
        for p in self.needs:
            out = out + self.may_match(found, [p]).cast("int")
        return out
