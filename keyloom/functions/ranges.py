"""Range arguments: scores, byte strings, ids and positions, as column conditions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_bound(text: str) -> tuple[float, bool]:
    """A score bound: ``(`` in front excludes it, ``-inf`` and ``+inf`` are open ends."""
    open_end = text.startswith("(")
    value = float(text[1:] if open_end else text)
    if math.isnan(value):
        raise ValueError("min or max is not a float")
    return value, open_end


def score_between(score: Column, low: str, high: str) -> Column:
    (a, a_open), (b, b_open) = score_bound(low), score_bound(high)
    return (score > a if a_open else score >= a) & (score < b if b_open else score <= b)


def lex_between(member: Column, low: str, high: str) -> Column:
    """Byte order between lex bounds: ``-`` and ``+`` alone, ``[`` includes, ``(`` excludes."""

    def side(bound: str, lower: bool) -> Column:
        if bound in ("-", "+"):
            return F.lit((bound == "-") == lower)
        if bound[:1] not in ("[", "("):
            raise ValueError("min or max not valid string range item")
        at = F.lit(bound[1:])
        if lower:
            return member > at if bound[0] == "(" else member >= at
        return member < at if bound[0] == "(" else member <= at

    return side(low, True) & side(high, False)


def position_between(pos: Column, size: Column, start: int, stop: int) -> Column:
    """Inclusive positions from 0; negative ones count from the end, and both ends are clamped."""
    a = F.greatest(size + start, F.lit(0)) if start < 0 else F.lit(start)
    b = size + stop if stop < 0 else F.lit(stop)
    return (pos >= a) & (pos <= b)


def glob_regex(pattern: str) -> str:
    r"""A regular expression for a glob: ``*``, ``?``, ``[a-z]``, ``[^a]`` and ``\x``."""
    out, i = [], 0
    special = set(r"\.^$|()[]{}*+?")
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("&&", "&\\&")
            out.append(f"[{inner}]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if pattern[i] in special else pattern[i])
        else:
            out.append("\\" + c if c in special else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(glob_regex(pattern))
