"""What a regular expression needs: strings without which it can't match."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _class_end(pattern: str, k: int) -> int:
    """The place of the bracket that ends the class that begins at k."""
    k += 1
    k += pattern[k : k + 1] == "^"
    k += pattern[k : k + 1] == "]"
    while k < len(pattern) and pattern[k] != "]":
        k += 2 if pattern[k] == "\\" else 1
    return k


def _group_end(pattern: str, k: int) -> int:
    depth = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[":
            k = _class_end(pattern, k)
        elif c == "\\":
            k += 1
        else:
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        k += 1
    return k


def _optional(pattern: str, k: int) -> bool:
    """Whether the quantifier at k, if there is one, allows none."""
    return pattern[k : k + 1] in ("?", "*") and pattern[k : k + 1] != "" or pattern[k : k + 1] == "{" and pattern[k + 1 :].split("}")[0].split(",")[0].strip() in ("", "0")


def requirements(pattern: str) -> list[list[frozenset[str]]]:
    """For each top-level alternative, in lower case: sets of strings of each of which all its matches have one.

    A run of plain characters is such a set of its own, a group that can't be left out one of a string for each of its
    alternatives. Classes, what a quantifier may leave out, look-arounds and escapes of more than a sign count for nothing.
    """
    out: list[list[frozenset[str]]] = [[]]
    run, k, n = "", 0, len(pattern)

    def ended() -> str:
        if run:
            out[-1].append(frozenset([run.lower()]))
        return ""

    while k < n:
        c = pattern[k]
        literal = None
        if c == "|":
            run = ended()
            out.append([])
        elif c == "[":
            run = ended()
            k = _class_end(pattern, k)
        elif c == "(":
            run = ended()
            end = _group_end(pattern, k)
            inside = pattern[k + 1 : end]
            if not inside.startswith("?") or inside.startswith("?:"):
                inner = requirements(inside.removeprefix("?:"))
                if all(inner) and not _optional(pattern, end + 1):
                    out[-1].append(frozenset().union(*[max(x, key=_weight) for x in inner]))
            k = end
        elif c in ".^$?*+{":
            run = ended()
            k = max(pattern.find("}", k), k) if c == "{" else k
        elif c == "\\":
            k += 1
            if k < n and not pattern[k].isalnum():
                literal = pattern[k]
            else:
                run = ended()
                c = pattern[k : k + 1]
                if c in ("0", "c", "k", "Q"):
                    return [[]]  # nothing is said of such patterns
                if c in ("x", "u", "p", "P"):
                    k = max(pattern.find("}", k), k) if pattern[k + 1 : k + 2] == "{" else k + {"x": 2, "u": 4}.get(c, 1)
        else:
            literal = c
        if literal is not None:
            if _optional(pattern, k + 1):
                run = ended()
            else:
                run += literal
        k += 1
    ended()
    return out


def _weight(strings: frozenset[str]) -> tuple[int, int]:
    """A set tells as much as its shortest string."""
    return min(map(len, strings)), -len(strings)


def literals(pattern: str) -> list[str] | None:
    """Strings of which each match has one, in lower case: for each alternative those that tell most; None if some has none."""
    found = requirements(pattern)
    return sorted(frozenset().union(*[max(x, key=_weight) for x in found])) if all(found) else None


#: What holds beyond an alternative: references to groups, quotations, flags, comments, and classes inside classes.
_BOUND = re.compile(r"\\[1-9kQ]|\(\?[a-zA-Z^-]|\[[^\]]*(?:\[|&&)|\[\^?\]")


def alternatives(pattern: str) -> list[str]:
    """Patterns of which one matches wherever the whole does, and only there: the top-level alternatives, or the pattern
    itself where one of them may depend on another."""
    if "|" not in pattern or _BOUND.search(pattern):
        return [pattern]
    out, begin, k = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "|":
            out.append(pattern[begin:k])
            begin = k + 1
        k = _class_end(pattern, k) if c == "[" else _group_end(pattern, k) if c == "(" else k + (c == "\\")
        k += 1
    return [*out, pattern[begin:]]


def _alternatives(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else alternatives(p))


def alternatives_of(patterns: Column) -> Column:
    """The same for a column of patterns, an array; null for null."""
    return F.pandas_udf(_alternatives, "array<string>")(patterns)


def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else literals(p))


def literals_of(patterns: Column) -> Column:
    """The same for a column of patterns, an array; null for null."""
    return F.pandas_udf(_literals, "array<string>")(patterns)
