"""Integer division. ``/`` of two integers gives an integer, as in the engine's dialect; Spark makes doubles of them.

Types are known only once Spark has analysed a statement. So the analysed plan is asked for divisions whose operands it
cast from integers on its own account; in the text, their ``/`` becomes ``DIV``, which binds alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

_INTEGRAL = {"byte", "short", "integer", "long"}
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."


def _possible(plan_json: str) -> bool:
    """Whether some division has two casts to double below it whose own operands are not known to be fractions."""
    if f'"{_EXPRESSIONS}Divide"' not in plan_json:
        return False

    def lists(x) -> Iterator[list]:
        if isinstance(x, list):
            if x and isinstance(x[0], dict) and "class" in x[0]:
                yield x
            for y in x:
                yield from lists(y)
        elif isinstance(x, dict):
            for y in x.values():
                yield from lists(y)

    for tree in lists(json.loads(plan_json)):
        for node, below, operand in zip(tree, tree[1:], tree[2:]):
            if node["class"] == f"{_EXPRESSIONS}Divide" and below["class"] == f"{_EXPRESSIONS}Cast" and below.get("dataType") == "double" and operand.get("dataType", "integer") in _INTEGRAL:
                return True
    return False


def _seq(s) -> Iterator:
    return (s.apply(i) for i in range(s.size()))


def _divisions(plan) -> Iterator:
    for e in _seq(plan.expressions()):
        yield from _in_expression(e)
    for p in _seq(plan.children()):
        yield from _divisions(p)


def _in_expression(e) -> Iterator:
    if e.getClass().getName() == f"{_EXPRESSIONS}Divide":
        yield e
    for c in _seq(e.children()):
        yield from _in_expression(c)
    if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        yield from _divisions(e.plan())


def _integral(operand, written) -> bool:
    """A cast over an integer that Spark put in: it does not carry the tag of those that are ``written`` in the text."""
    if operand.getClass().getName() != f"{_EXPRESSIONS}Cast" or operand.getTagValue(written).isDefined():
        return False
    return operand.child().dataType().typeName() in _INTEGRAL


def integer_divisions(df: DataFrame, text: str, tokens: list[str]) -> str | None:
    """``text`` with ``DIV`` for the integer divisions that ``df``, its analysis, shows; None if there are none."""
    plan = df._jdf.queryExecution().analyzed()
    if "/" not in tokens or not _possible(plan.toJSON()):
        return None
    starts, at = [], 0
    for t in tokens:
        starts.append(at)
        at += len(t)
    turned = set()
    written = df.sparkSession._jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
    for e in _divisions(plan):
        where = e.origin()
        if not (_integral(e.left(), written) and _integral(e.right(), written) and where.startIndex().isDefined() and where.sqlText().isDefined() and where.sqlText().get() == text):
            continue
        first, last = where.startIndex().get(), where.stopIndex().get()
        depth, found = 0, None
        for k, (t, s) in enumerate(zip(tokens, starts)):
            if first <= s <= last:
                depth += (t in "([") - (t in ")]")
                found = k if t == "/" and depth == 0 else found  # the last one: divisions group from the left
        if found is not None:
            turned.add(found)
    return "".join(" DIV " if k in turned else t for k, t in enumerate(tokens)) if turned else None
