"""Arithmetic texts, evaluated in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TOKEN = re.compile(r"[0-9][0-9.]*|[-+*/()]")
_NUMBER = re.compile(r"[0-9]*\.?[0-9]*")
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2}


def postfix(text: str) -> list[str] | None:
    """The tokens in postfix order; None if a closing bracket has no opening one. Operators
    of equal rank go from left to right; there is no sign; an open bracket is kept."""
    out: list[str] = []
    ops: list[str] = []
    for t in _TOKEN.findall(text):
        if t == "(":
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif t in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
        else:
            out.append(t)
    return out + ops[::-1]


def evaluated(tokens: list[str]) -> float:
    """The value of postfix tokens: 0 if operands are missing or none is left; a division
    by zero takes both operands and gives nothing."""
    stack: list[float] = []
    for t in tokens:
        if t in _RANK:
            if len(stack) < 2:
                return 0.0
            b, a = stack.pop(), stack.pop()
            if t != "/":
                stack.append(a + b if t == "+" else a - b if t == "-" else a * b)
            elif b != 0:
                stack.append(a / b)
        elif t != "(":
            stack.append(float(_NUMBER.match(t).group()))
    return stack[-1] if stack else 0.0


@F.arrow_udf(DoubleType())
def _values(texts: pa.Array) -> pa.Array:
    tokens = (None if t is None else postfix(t) for t in texts.to_pylist())
    return pa.array([None if t is None else evaluated(t) for t in tokens], pa.float64())


def value(text: Column) -> Column:
    return _values(text)
