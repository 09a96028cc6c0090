"""Repair times that users write as a formula in x (hours): the share of ships repaired by then.

A formula may hold numbers, x, pi, + - * / % // **, comparisons, and / or / not, and exp, log, sqrt, sin, cos, abs and
norm.cdf, with or without np. in front.  Anything else is refused: such a scenario has a finding, not a value.
"""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.functions import expr as X

_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.FloorDiv: "//", ast.Pow: "**"}
_COMPARE = {ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_FUNCTIONS = ("exp", "log", "sqrt", "sin", "cos", "abs")
#: Formulas longer than this are refused.
LONGEST = 500


class Refused(ValueError):
    """A formula with something that is not allowed, or that is none."""


def sql_of(text: str) -> str:
    """SQL in a column x, in doubles, of an allowed formula."""
    if text is None or len(text) > LONGEST:
        raise Refused("no formula" if text is None else "too long")
    try:
        return _number(ast.parse(text.strip(), mode="eval").body)
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise Refused(f"no formula: {type(e).__name__}") from None


def _number(node: ast.AST) -> str:
    """A condition counts as 1 or 0 where a number is asked for."""
    is_condition = isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not)
    return f"(CASE WHEN {_sql(node)} THEN 1e0 ELSE 0e0 END)" if is_condition else _sql(node)


def _sql(node: ast.AST) -> str:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return f"({X.num(node.value)})"
    if isinstance(node, ast.Name) and node.id in ("x", "pi"):
        return "x" if node.id == "x" else X.num(np.pi)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd, ast.Not)):
        return f"(NOT {_truth(node.operand)})" if isinstance(node.op, ast.Not) else f"({'-' if isinstance(node.op, ast.USub) else ''}{_sql(node.operand)})"
    if isinstance(node, ast.BoolOp):
        return "(" + (" AND " if isinstance(node.op, ast.And) else " OR ").join(map(_truth, node.values)) + ")"
    if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
        sides = [_sql(n) for n in (node.left, *node.comparators)]
        return "(" + " AND ".join(f"{a} {_COMPARE[type(o)]} {b}" for a, o, b in zip(sides, node.ops, sides[1:])) + ")"
    if isinstance(node, ast.BinOp) and (op := _BINARY.get(type(node.op))):
        a, b = _number(node.left), _number(node.right)
        whole = f"floor({a} / nullif({b}, 0e0))"
        return {"**": f"pow({a}, {b})", "//": whole, "%": f"({a} - {b} * {whole})", "/": f"({a} / nullif({b}, 0e0))"}.get(op, f"({a} {op} {b})")
    if isinstance(node, ast.Call) and len(node.args) == 1 and not node.keywords and not isinstance(node.args[0], ast.Starred):
        name, arg = ast.unparse(node.func), _sql(node.args[0])
        name = name.removeprefix("np.").removeprefix("numpy.").removeprefix("stats.")
        if name in _FUNCTIONS:
            return f"{'ln' if name == 'log' else name}({arg})"
        if name == "norm.cdf":
            return X.phi(arg)
    raise Refused(f"not allowed: {type(node).__name__}")


def _truth(node: ast.AST) -> str:
    if not isinstance(node, (ast.Compare, ast.BoolOp)) and not (isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not)):
        raise Refused("not a condition")
    return _sql(node)


def _refusal(text: str | None) -> str | None:
    try:
        sql_of(text)
    except Refused as e:
        return str(e)
    return None


def findings(scenarios: DataFrame, text: str = "repair_text") -> DataFrame:
    """scenario_id, check, detail of the scenarios whose formula is refused."""
    checked = F.pandas_udf(lambda texts: texts.map(_refusal, na_action=None).astype(object), "string")
    return scenarios.select("scenario_id", checked(text).alias("detail")).where("detail is not null").select("scenario_id", F.lit("repair_text").alias("check"), "detail")


def _value(node: ast.AST, x: np.ndarray):
    """The formula over an array; refused ones have been sorted out by sql_of."""
    if isinstance(node, ast.Constant):
        return float(node.value)
    if isinstance(node, ast.Name):
        return x if node.id == "x" else np.pi
    if isinstance(node, ast.UnaryOp):
        v = _value(node.operand, x)
        return ~v if isinstance(node.op, ast.Not) else -v if isinstance(node.op, ast.USub) else v
    if isinstance(node, ast.BoolOp):
        return (np.logical_and if isinstance(node.op, ast.And) else np.logical_or).reduce([_value(n, x) for n in node.values])
    if isinstance(node, ast.Compare):
        sides = [_value(n, x) for n in (node.left, *node.comparators)]
        do = {ast.Eq: np.equal, ast.NotEq: np.not_equal, ast.Lt: np.less, ast.LtE: np.less_equal, ast.Gt: np.greater, ast.GtE: np.greater_equal}
        return np.logical_and.reduce([do[type(o)](a, b) for a, o, b in zip(sides, node.ops, sides[1:])])
    if isinstance(node, ast.BinOp):
        do = {ast.Add: np.add, ast.Sub: np.subtract, ast.Mult: np.multiply, ast.Div: np.divide, ast.Mod: np.mod, ast.FloorDiv: np.floor_divide, ast.Pow: np.power}
        return do[type(node.op)](_value(node.left, x), _value(node.right, x))
    import math

    name, v = ast.unparse(node.func).rpartition(".")[2], _value(node.args[0], x)
    return np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))(v) if name == "cdf" else getattr(np, name)(v)


def repaired(rows: DataFrame, text: str = "repair_text", hours: str = "hours", out: str = "p_repaired") -> DataFrame:
    """Adds out: the share repaired by hours, by each row's own formula; null where it is refused or gives no number.

    Each formula is read once a batch and worked on all its rows together.  Of one formula for all rows take
    F.expr(sql_of(text)) instead, which stays in the JVM.
    """

    @F.pandas_udf("double")
    def run(texts: pd.Series, x: pd.Series) -> pd.Series:
        result = np.full(len(texts), np.nan)
        for t, at in texts.groupby(texts, dropna=True).indices.items():
            try:
                sql_of(t)
            except Refused:
                continue
            with np.errstate(all="ignore"):
                result[at] = np.asarray(_value(ast.parse(t.strip(), mode="eval").body, x.to_numpy(np.float64)[at]), np.float64)
        return pd.Series(result).where(np.isfinite(result))

    return rows.withColumn(out, run(text, F.col(hours).cast("double")))
