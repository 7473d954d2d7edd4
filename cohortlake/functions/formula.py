"""A small model-formula language: ``y ~ a + b + a:b``, ``a * b``, ``C(x)``, ``log(x)``, ``I(x ** 2)``, ``0 +``, ``- 1``.

Text columns and C(...) are categorical. A categorical factor loses its first level (in sorted order) wherever the term
without it is in the model too, so designs have full rank.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "Intercept"
#: Levels of a categorical factor at most: each becomes a column of the design.
MOST_LEVELS = 500


def split_formula(formula: str) -> tuple[str, str]:
    """(outcome, right side); an outcome alone has the right side 1."""
    left, _, right = formula.partition("~")
    return left.strip(), right.strip() or "1"


def _pieces(text: str, marks: str) -> list[tuple[str, str]]:
    """(mark before it, piece) at the outermost level of brackets; ** is not a mark."""
    out, depth, start, mark, k = [], 0, 0, "+", 0
    while k < len(text):
        c = text[k]
        depth += (c == "(") - (c == ")")
        if c == "*" and text[k : k + 2] == "**":
            k += 2
            continue
        if c in marks and depth == 0 and (text[start:k].strip() or c not in "+-"):
            out.append((mark, text[start:k].strip()))
            mark, start = c, k + 1
        k += 1
    out.append((mark, text[start:].strip()))
    return out


def terms(right: str) -> tuple[bool, list[tuple[str, ...]]]:
    """(whether there is an intercept, the terms as tuples of factors), lower orders first."""
    intercept, found = True, []
    for mark, piece in _pieces(right, "+-"):
        if piece in ("1", "0"):
            intercept = (piece == "1") == (mark == "+")
            continue
        factors = [tuple(p for _, p in _pieces(f, ":")) for _, f in _pieces(piece, "*")]
        made: list[tuple[str, ...]] = [()]
        for f in factors:
            made += [tuple(dict.fromkeys(m + f)) for m in made]
        made = [m for m in made if m] if len(factors) > 1 else [factors[0]]
        for m in made:
            if mark == "-":
                found = [x for x in found if set(x) != set(m)]
            elif not any(set(x) == set(m) for x in found):
                found.append(m)
    return intercept, sorted(found, key=len)


@dataclass
class Design:
    names: list[str]
    columns: list[Column]
    #: Columns of the data that the formula reads.
    used: list[str]


def _expression(factor: str) -> str:
    inner = re.fullmatch(r"I\((.*)\)", factor)
    text = inner[1] if inner else factor
    text = re.sub(r"\blog\(", "ln(", text)
    while "**" in text:
        text = re.sub(r"([\w.]+|\([^()]*\))\s*\*\*\s*([\w.]+|\([^()]*\))", r"power(\1, \2)", text, count=1)
    return text


def design(df: DataFrame, right: str) -> Design:
    """The columns of the right side; levels of categorical factors are looked up in df."""
    intercept, found = terms(right)
    kinds = dict(df.dtypes)
    used = [c for c in df.columns if any(re.search(rf"(?<![\w.]){re.escape(c)}(?![\w(])", f) for t in found for f in t)]
    levels: dict[str, list] = {}
    for factor in dict.fromkeys(f for t in found for f in t):
        name = (re.fullmatch(r"C\((.*)\)", factor) or [None, factor])[1].strip()
        if factor.startswith("C(") or kinds.get(name) == "string":
            levels[factor] = sorted(r[0] for r in df.select(F.col(name)).filter(F.col(name).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect())
            if len(levels[factor]) > MOST_LEVELS:
                raise ValueError(f"{factor} has more than {MOST_LEVELS} levels")
    present = [set(t) for t in found] + ([set()] if intercept else [])
    names, columns = ([INTERCEPT], [F.lit(1.0)]) if intercept else ([], [])
    for term in found:
        parts: list[tuple[list[str], Column]] = [([], F.lit(1.0))]
        for factor in term:
            if factor in levels:
                name = (re.fullmatch(r"C\((.*)\)", factor) or [None, factor])[1].strip()
                drop = (set(term) - {factor}) in present
                options = [(f"{factor}[T.{v}]" if drop else f"{factor}[{v}]", (F.col(name) == v).cast("double")) for v in levels[factor][drop:]]
            else:
                options = [(factor, F.expr(_expression(factor)).cast("double"))]
            parts = [([*n, o], c * x) for n, c in parts for o, x in options]
        names += [":".join(n) for n, _ in parts]
        columns += [c for _, c in parts]
        present.append(set(term))
    return Design(names, columns, used)
