"""Model-backed steps behind replaceable backends, with deterministic stand-ins.

Rows that don't need a step come to it as null and are taken out before the backend is called, so a table is read once.
"""

from __future__ import annotations

import ast
import hashlib
import math
import operator
import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.functions.text import file_name

Embedder = Callable[[list[str]], list[list[float] | None]]
Answerer = Callable[[list[str]], list[str]]
DIMENSION = 768


def hashed_embedder(texts: list[str], dimension: int = DIMENSION) -> list[list[float] | None]:
    """A stand-in: unit vectors drawn from a hash of each text; none for an empty one."""
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        v = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little"))).normal(size=dimension)
        out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
    return out


def echo(prompts: list[str]) -> list[str]:
    """A stand-in for a language or vision model: the prompt's last line."""
    return [p.rstrip().rsplit("\n", 1)[-1] if p else "" for p in prompts]


def embedded(rows: DataFrame, text_col: str, backend: Embedder = hashed_embedder, name: str = "vector") -> DataFrame:
    """``rows`` with a vector each, null where the backend has none; a worker takes whole batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(backend(texts.fillna("").tolist()), dtype=object)

    return rows.withColumn(name, run(F.col(text_col)))


def answered(rows: DataFrame, prompt_col: str, gate: Column, backend: Answerer = echo, name: str = "answer") -> DataFrame:
    """``rows`` with the backend's answer where the gate is true, null elsewhere."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out, asked = pd.Series([None] * len(prompts), dtype=object), prompts.notna().to_numpy()
            if asked.any():
                out[asked] = backend(prompts[asked].tolist())
            yield out

    return rows.withColumn(name, run(F.when(F.coalesce(gate, F.lit(False)), F.coalesce(prompt_col, F.lit("")))))


_TAG = re.compile(r"({{.*?}}|{%.*?%}\n?)", re.DOTALL)


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(name, template) of the template files in a folder."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.jinja2")
    return rows.select(F.regexp_replace(file_name(F.input_file_name()), r"\.jinja2$", "").alias("name"), F.col("value").alias("template")).orderBy("name")


def rendered(template: str, **values: Column) -> Column:
    """A prompt from a template as one column expression; a null value is empty.

    Places are ``{{ name }}``, ``{{ name.field }}``, ``{{ name if name else "text" }}`` and ``{{ "a" if name else "b" }}``;
    blocks ``{% if name %} {% else %} {% endif %}`` and, over an array, ``{% for x in name %} {% endfor %}`` with
    ``{{ loop.index }}``. A value holds if it is neither null, empty, zero nor false.
    """
    parts = [p for p in _TAG.split(template) if p]

    def found(name: str, scope: dict[str, Column]) -> Column:
        if re.fullmatch(r"'[^']*'|\"[^\"]*\"", name):
            return F.lit(name[1:-1])
        first, *fields = name.split(".")
        if first == "loop":
            return scope["loop.index"]
        if first not in scope:
            return F.lit(None)
        out = scope[first]
        for f in fields:
            out = out[f]
        return out

    def holds(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(~text.isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False))

    def place(inner: str, scope: dict[str, Column]) -> Column:
        chosen = re.fullmatch(r"(.+?) if (.+?) else (.+)", inner)
        c = F.when(holds(found(chosen[2], scope)), found(chosen[1], scope).cast("string")).otherwise(found(chosen[3], scope).cast("string")) if chosen else found(inner, scope).cast("string")
        return F.coalesce(c, F.lit(""))

    def block(at: int, scope: dict[str, Column], ends: tuple[str, ...]) -> tuple[Column, int]:
        out = [F.lit("")]
        while at < len(parts):
            p = parts[at]
            inner = p.strip("\n")[2:-2].strip()
            if p.startswith("{{"):
                out.append(place(inner, scope))
            elif not p.startswith("{%"):
                out.append(F.lit(p))
            elif inner in ends:
                return F.concat(*out), at
            elif inner.startswith("if "):
                yes, at = block(at + 1, scope, ("else", "endif"))
                no = F.lit("")
                if "else" in parts[at]:
                    no, at = block(at + 1, scope, ("endif",))
                out.append(F.when(holds(found(inner[3:].strip(), scope)), yes).otherwise(no))
            elif loop := re.fullmatch(r"for (\w+) in ([\w.]+)", inner):
                ends_at = []

                def body(x: Column, i: Column) -> Column:  # called at once
                    text, end = block(at + 1, scope | {loop[1]: x, "loop.index": i + 1}, ("endfor",))
                    ends_at.append(end)
                    return text

                out.append(F.coalesce(F.array_join(F.transform(found(loop[2], scope), body), ""), F.lit("")))
                at = ends_at[0]
            else:
                raise ValueError(f"not understood: {p.strip()}")
            at += 1
        if ends:
            raise ValueError(f"missing {ends[-1]}")
        return F.concat(*out), at

    return block(0, dict(values), ())[0]


def transcribed(videos: DataFrame, backend: Callable[[str], list[tuple[float, float, str]]], asset_col: str = "asset", path_col: str = "path") -> DataFrame:
    """(asset, start, end, segment_id, text): what the backend hears in each video, none to many rows, times to two places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asset, path in batch.itertuples(index=False):
                rows = [(asset, round(a, 2), round(b, 2), i, t.strip()) for i, (a, b, t) in enumerate(backend(path))]
                yield pd.DataFrame(rows, columns=["asset", "start", "end", "segment_id", "text"])

    return videos.select(F.col(asset_col).cast("string").alias("asset"), F.col(path_col)).mapInPandas(run, "asset string, start double, end double, segment_id int, text string")


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos}
_CALLS = {n: getattr(math, n) for n in ("sqrt", "exp", "log", "sin", "cos", "tan", "floor", "ceil")} | {"abs": abs}
_NAMES = {"pi": math.pi, "e": math.e}


#: Powers that a formula may have.
MOST_DEGREE = 32


def evaluated(expression: str, names: dict[str, float] = {}) -> float | None:
    """Value of an arithmetic expression over numbers, a few functions and constants, and ``names``; None for anything else."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return float(node.value)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            return math.pow(value(node.left), value(node.right))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            return _UNARY[type(node.op)](value(node.operand))
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.Name) and node.id in _NAMES:
            return _NAMES[node.id]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and len(node.args) == 1 and not node.keywords:
            return _CALLS[node.func.id](value(node.args[0]))
        raise ValueError

    try:
        found = value(ast.parse(expression.strip(), mode="eval").body)
    except (ValueError, SyntaxError, ArithmeticError, RecursionError, MemoryError, TypeError):
        return None
    return found if math.isfinite(found) else None


def calculated(rows: DataFrame, expression_col: str, name: str = "result") -> DataFrame:
    """``rows`` with the value of an expression; null where it is empty, the word ``empty``, or not arithmetic.

    Nothing is executed. ``reckoned`` has the other modes.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([evaluated(t) if t else None for t in texts], dtype="float64")

    value = run(F.nullif(F.col(expression_col), F.lit("empty")))
    return rows.withColumn(name, F.nanvl(value, F.lit(None).cast("double")))


def polynomial(expression: str, symbol: str) -> list[Fraction]:
    """Coefficients, constant first, of an expression that is a polynomial of the symbol; ``a = b`` stands for a - b."""

    def added(a, b, sign=1):
        n = max(len(a), len(b))
        return [(a[i] if i < len(a) else 0) + sign * (b[i] if i < len(b) else 0) for i in range(n)]

    def times(a, b):
        out = [Fraction(0)] * (len(a) + len(b) - 1)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                out[i + j] += x * y
        if len(out) > MOST_DEGREE + 1:
            raise ValueError
        return out

    def value(node: ast.AST) -> list[Fraction]:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return [Fraction(str(node.value))]
        if isinstance(node, ast.Name) and node.id == symbol:
            return [Fraction(0), Fraction(1)]
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            return [_UNARY[type(node.op)](x) for x in value(node.operand)]
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Add | ast.Sub):
                return added(a, b, 1 if isinstance(node.op, ast.Add) else -1)
            if isinstance(node.op, ast.Mult):
                return times(a, b)
            if isinstance(node.op, ast.Div) and len(b) == 1:
                return [x / b[0] for x in a]
            if isinstance(node.op, ast.Pow) and len(b) == 1 and b[0].denominator == 1 and 0 <= b[0] <= MOST_DEGREE:
                out = [Fraction(1)]
                for _ in range(int(b[0])):
                    out = times(out, a)
                return out
        raise ValueError

    left, _, right = expression.partition("=")
    sides = [value(ast.parse(s.strip(), mode="eval").body) for s in ((left, right) if right else (left,))]
    out = added(sides[0], sides[1], -1) if right else sides[0]
    while len(out) > 1 and not out[-1]:
        out.pop()
    return out


def _number(x: Fraction) -> str:
    return str(x.numerator) if x.denominator == 1 else ("-" if x < 0 else "") + rf"\frac{{{abs(x.numerator)}}}{{{x.denominator}}}"


def simplified(expression: str, symbol: str = "x") -> str:
    """A polynomial with its powers gathered, highest first, as a formula."""
    out = ""
    terms = polynomial(expression, symbol)
    for i, c in reversed(list(enumerate(terms))):
        if c or len(terms) == 1:
            power = "" if i == 0 else symbol if i == 1 else f"{symbol}^{{{i}}}"
            size = power if power and abs(c) == 1 else f"{_number(abs(c))} {power}".strip()
            out += (" - " if c < 0 else " + ") + size if out else ("- " if c < 0 else "") + size
    return out or "0"


def solved(expression: str, symbol: str = "x") -> list[str]:
    """Real and complex roots of a polynomial of at most the second degree, exactly, as formulas in ascending order."""
    c, *more = polynomial(expression, symbol)
    if len(more) == 1:
        return [_number(-c / more[0])]
    if len(more) != 2:
        raise ValueError
    b, a = more
    middle, inner = -b / (2 * a), (b * b - 4 * a * c) / (4 * a * a)
    root = [math.isqrt(abs(inner.numerator)), math.isqrt(inner.denominator)]
    exact = root[0] ** 2 == abs(inner.numerator) and root[1] ** 2 == inner.denominator
    if exact and inner >= 0:
        return [_number(x) for x in sorted({middle - Fraction(*root), middle + Fraction(*root)})]
    size = _number(Fraction(*root)) if exact else rf"\sqrt{{{_number(abs(inner))}}}"
    size = ("i" if size == "1" else size + " i") if inner < 0 else size
    front = _number(middle) + " " if middle else ""
    return [f"{front}- {size}", f"{front}+ {size}" if front else size]


def scripted(lines: str) -> dict[str, str]:
    """Values of a script of plain assignments, one a line, each an arithmetic expression over the names before it."""
    names: dict[str, float] = {}
    for node in ast.parse(lines).body:
        if not (isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name)):
            raise ValueError
        found = evaluated(ast.unparse(node.value), names)
        if found is None:
            raise ValueError
        names[node.targets[0].id] = found
    return {k: repr(v) for k, v in names.items() if not k.startswith("__")}


def reckoned(rows: DataFrame, expression_col: str = "expression", mode_col: str = "mode", symbol_col: str = "symbol", name: str = "result") -> DataFrame:
    """``rows`` with a struct: ``values`` (texts by place or name) or ``error``.

    Modes are eval, solve, simplify and script; formulas are polynomials with rational coefficients. What isn't
    understood, and any other mode, is an error of that row. Nothing is executed.
    """

    def one(expression: str | None, mode: str | None, symbol: str | None) -> dict:
        try:
            if mode == "script":
                found = scripted(expression)
            elif mode == "solve":
                found = dict(enumerate(solved(expression, symbol or "x")))
            elif mode == "simplify":
                found = {0: simplified(expression, symbol or "x")}
            elif mode == "eval" and (x := evaluated(expression)) is not None:
                found = {0: repr(x)}
            else:
                raise ValueError
        except (ValueError, SyntaxError, ArithmeticError, RecursionError, MemoryError, TypeError, AttributeError):
            return {"values": None, "error": f"not understood: {mode}"}
        return {"values": {str(k): v for k, v in found.items()}, "error": None}

    @F.pandas_udf("values map<string,string>, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for e, m, s in batches:
            yield pd.DataFrame([one(*x) for x in zip(e, m, s, strict=True)], columns=["values", "error"])

    return rows.withColumn(name, run(F.col(expression_col), F.col(mode_col), F.col(symbol_col)))


def public_fields(result: Column) -> Column:
    """A script's result without the keys that begin with two underscores."""
    return F.map_filter(result, lambda k, v: ~F.startswith(k, F.lit("__")))
