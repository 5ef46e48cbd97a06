"""A small stack language over lazy matrices.

Tokens are separated by white space: ``/text`` pushes a string, ``.name`` the
value of a name (or the name itself if it has none), digits a number (a double
if it has a point), ``{ ... }`` a block, anything else is an operator. Nothing
runs until a result is asked for, so the planner sees whole programs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.functions.edge import power, unary
from gridloom.matrix import Matrix
from gridloom.operators import aggregates, flow, reshape, setops
from gridloom.sources import native


class Block(str):
    """Tokens between braces."""


class Name(str):
    """A name without a value."""


class ProgramError(ValueError):
    pass


class Machine:
    """Runs programs; ``names`` may hold matrices to start with, ``stack[-1]`` is the top."""

    def __init__(self, spark: SparkSession, names: dict[str, Any] | None = None, digits: int = 6):
        self.spark, self.names, self.digits, self.done = spark, dict(names or {}), digits, False
        self.stack: list[Any] = []

    # ---- the loop
    def run(self, program: str) -> list[Any]:
        tokens, at = program.split(), 0
        while at < len(tokens) and not self.done:
            t = tokens[at]
            at += 1
            if t == "{":
                depth, start = 1, at
                while depth:
                    if at >= len(tokens):
                        raise ProgramError("block without end")
                    depth += {"{": 1, "}": -1}.get(tokens[at], 0)
                    at += 1
                self.stack.append(Block(" ".join(tokens[start : at - 1])))
            elif t == "}":
                raise ProgramError("end of block without beginning")
            elif t[0] == "/":
                self.stack.append(t[1:])
            elif t[0] == ".":
                self.stack.append(self.names.get(t[1:], Name(t[1:])))
            elif t[0].isdigit() or t[0] == "-" and len(t) > 1:
                self.stack.append(float(t) if "." in t else int(t))
            else:
                op = OPERATORS.get(t)
                if op is None:
                    raise ProgramError(f"unknown operator {t!r}")
                op(self)
        return self.stack

    def pop(self, *kinds: type) -> Any:
        if not self.stack:
            raise ProgramError("stack is empty")
        x = self.stack.pop()
        if kinds and not isinstance(x, kinds) or (kinds and Matrix not in kinds and isinstance(x, (Block, Name)) and type(x) not in kinds):
            raise ProgramError(f"expected {' or '.join(k.__name__ for k in kinds)}, found {type(x).__name__}")
        return x

    def push(self, *xs: Any) -> None:
        self.stack.extend(xs)


_NUMBER = (int, float)


def _number(x: Any) -> bool:
    return isinstance(x, _NUMBER) and not isinstance(x, bool)


def _both(scalar: Callable, matrices: Callable | None = None, scaled: Callable | None = None) -> Callable[[Machine], None]:
    def f(m: Machine) -> None:
        b, a = m.pop(), m.pop()
        if _number(a) and _number(b):
            m.push(scalar(a, b))
        elif isinstance(a, Matrix) and isinstance(b, Matrix) and matrices:
            m.push(matrices(a, b))
        elif scaled and isinstance(a, Matrix) != isinstance(b, Matrix) and (_number(a) or _number(b)):
            m.push(scaled(a if isinstance(a, Matrix) else b, b if isinstance(a, Matrix) else a))
        else:
            raise ProgramError(f"cannot combine {type(a).__name__} and {type(b).__name__}")

    return f


def _one(g: Callable[[Matrix], Any]) -> Callable[[Machine], None]:
    return lambda m: m.push(g(m.pop(Matrix)))


def _div(a: float, b: float) -> float:
    if b == 0:
        raise ProgramError("division by zero")
    return a // b if isinstance(a, int) and isinstance(b, int) else a / b


def _scaled(m: Matrix, f: float) -> Matrix:
    return m.put(m.cells.withColumn("val", F.col("val") * float(f)))


def _addto(m: Machine) -> None:
    b = m.stack[-1] if m.stack else None
    OPERATORS["add"](m)
    m.push(b)


def _beside(g: Callable[[Matrix], Any]) -> Callable[[Machine], None]:
    """The result on top of the matrix, which stays."""

    def f(m: Machine) -> None:
        x = m.pop(Matrix)
        m.push(x, g(x))

    return f


def _block(m: Machine) -> None:
    dom, mx = m.pop(Matrix), m.pop(Matrix)
    cl = dom.cells.select(F.col("col_id").alias("cluster"), F.col("row_id").alias("node"))
    m.push(reshape.block_union(mx, cl, inside=False), reshape.block_union(mx, cl))


def _pow(m: Machine) -> None:
    b, a = m.pop(*_NUMBER), m.pop()
    m.push(setops.matrix_power(a, int(b)) if isinstance(a, Matrix) else a**b)


def _clusters(m: Matrix) -> Matrix:
    cl = flow.interpret(flow.dag(m))
    return Matrix.of(cl.select(F.col("cluster").alias("col_id"), F.col("node").alias("row_id"), F.lit(1.0).alias("val")))


def _new(m: Machine) -> None:
    rows, cols = m.pop(int), m.pop(int)
    empty = m.spark.createDataFrame([], "col_id bigint, row_id bigint, val double")
    m.push(Matrix(empty, m.spark.range(cols), m.spark.range(rows)))


def _all_one(m: Machine) -> None:
    rows, cols = m.pop(int), m.pop(int)
    m.push(setops.all_cells(m.spark.range(cols), m.spark.range(rows)))


def _set(m: Machine) -> None:
    v, row, col, mx = m.pop(*_NUMBER), m.pop(int), m.pop(int), m.pop(Matrix)
    m.push(reshape.upsert(mx, col, row, v))


def _ifelse(m: Machine) -> None:
    no, yes, test = m.pop(Block), m.pop(Block), m.pop(int)
    m.run(yes if test else no)


def _while(m: Machine) -> None:
    body, test = m.pop(Block), m.pop(Block)
    while True:
        m.run(test)
        if not m.pop(int):
            return
        m.run(body)


def _repeat(m: Machine) -> None:
    body, n = m.pop(Block), m.pop(int)
    for _ in range(n):
        m.run(body)


def _def(m: Machine) -> None:
    """``value .name def``; a name that has a value arrives as that value, so the text form ``/name`` renames."""
    name, value = m.pop(str), m.pop()
    m.names[str(name)] = value


def _unlink(m: Machine) -> None:
    """Takes a name's value away from it and pushes it; the name comes as text."""
    name = str(m.pop(str))
    if name not in m.names:
        raise ProgramError(f"no value in {name!r}")
    m.push(m.names.pop(name))


def _roll(m: Machine) -> None:
    j, n = m.pop(int), m.pop(int)
    if n > len(m.stack) or n < 0:
        raise ProgramError("not so many on the stack")
    if n:
        part = m.stack[-n:]
        j %= n
        m.stack[-n:] = part[-j:] + part[:-j] if j else part


def _mdup(m: Machine) -> None:
    n = m.pop(int)
    if n > len(m.stack):
        raise ProgramError("not so many on the stack")
    m.push(*m.stack[len(m.stack) - n :])


def _exch(m: Machine) -> None:
    b, a = m.pop(), m.pop()
    m.push(b, a)


def _load_file(m: Machine) -> None:
    path = m.pop(str)
    m.run(" ".join(r.value for r in m.spark.read.text(path).where("value IS NOT NULL").toLocalIterator()))


def _load_matrix(m: Machine) -> None:
    path = m.pop(str)
    m.push(native.read_interchange(m.spark, path) if path.endswith((".mci", ".txt")) else native.read(m.spark, path))


def _write_matrix(m: Machine) -> None:
    path, mx = m.pop(str), m.pop(Matrix)
    native.write(mx, path)
    m.push(mx)


def _view(m: Machine) -> None:
    mx = m.pop(Matrix)
    mx.cells.select("col_id", "row_id", F.round("val", m.digits).alias("val")).orderBy("col_id", "row_id").show()
    m.push(mx)


def _tell(m: Machine) -> None:
    for x in m.stack[len(m.stack) - m.pop(int) :]:
        print(type(x).__name__, x if not isinstance(x, Matrix) else x.cells.schema.simpleString())


def _digits(m: Machine) -> None:
    m.digits = m.pop(int)


def _quit(m: Machine) -> None:
    m.done = True


def _explain(m: Machine) -> None:
    if m.stack and isinstance(m.stack[-1], Matrix):
        m.stack[-1].cells.explain()


def _free(m: Machine) -> None:
    x = m.pop()
    if isinstance(x, Matrix):
        x.cells.unpersist()


def _pop_count(d: Callable[[Matrix], Any]) -> Callable[[Machine], None]:
    return lambda m: m.push(d(m.pop(Matrix)).count())


def _square(m: Machine) -> None:
    mx = m.pop(Matrix)
    c, r = mx.cols.count(), mx.rows.count()
    if c != r:
        raise ProgramError(f"{r} rows but {c} columns")
    m.push(mx, c)


def _compare(f: Callable[[Any, Any], bool]) -> Callable[[Machine], None]:
    return _both(lambda a, b: int(f(a, b)))


OPERATORS: dict[str, Callable[[Machine], None]] = {
    "add": _both(lambda a, b: a + b, lambda a, b: setops.binary(a, b, "add")),
    "addto": _addto,
    "addtp": _one(lambda m: setops.add_transpose(m, 0.5)),
    "block": _block,
    "pow": _pow,
    "mod": _both(lambda a, b: int(math.fmod(a, b))),
    "min": _both(min, lambda a, b: setops.binary(a, b, "min")),
    "max": _both(max, lambda a, b: setops.binary(a, b, "max")),
    "div": _both(_div, None, lambda m, s: _scaled(m, 1 / s)),
    "mul": _both(lambda a, b: a * b, setops.compose, _scaled),
    "hdm": lambda m: (lambda b, a: m.push(setops.hadamard(a, b)))(m.pop(Matrix), m.pop(Matrix)),
    "hdp": lambda m: (lambda p, a: m.push(unary(a, power(p))))(m.pop(*_NUMBER), m.pop(Matrix)),
    "xpn": lambda m: m.push(flow.expand(m.pop(Matrix))),
    "infl": lambda m: (lambda p, a: m.push(aggregates.inflate(a, p)))(m.pop(*_NUMBER), m.pop(Matrix)),
    "st": _one(aggregates.stochastic),
    "ch": _one(reshape.characteristic),
    "tp": _beside(lambda m: m.t),
    "imac": _beside(_clusters),
    "new": _new,
    "id": lambda m: m.push(setops.identity(m.spark.range(m.pop(int)))),
    "jj": _all_one,
    "set": _set,
    "size": _beside(lambda m: m.cells.count()),
    "dim": _square,
    "cdim": _pop_count(lambda m: m.cols),
    "rdim": _pop_count(lambda m: m.rows),
    "eq": _compare(lambda a, b: a == b),
    "lq": _compare(lambda a, b: a <= b),
    "lt": _compare(lambda a, b: a < b),
    "gq": _compare(lambda a, b: a >= b),
    "gt": _compare(lambda a, b: a > b),
    "ifelse": _ifelse,
    "while": _while,
    "repeat": _repeat,
    "do": lambda m: m.run(m.pop(Block)) and None,
    "lm": _load_matrix,
    "lf": _load_file,
    "wm": _write_matrix,
    "vm": _view,
    "copy": lambda m: m.push(m.stack[-1]),
    "dup": lambda m: m.push(m.stack[-1]),
    "mdup": _mdup,
    "exch": _exch,
    "roll": _roll,
    "pop": lambda m: m.pop() and None,
    "clear": lambda m: m.stack.clear(),
    "list": lambda m: m.push(" ".join(type(x).__name__ for x in m.stack)),
    "def": _def,
    "unlink": _unlink,
    "free": _free,
    "vars": lambda m: m.push(" ".join(sorted(m.names))),
    "info": _explain,
    "tell": _tell,
    "help": lambda m: m.push(" ".join(sorted(OPERATORS))),
    "ops": lambda m: m.push(" ".join(sorted(OPERATORS))),
    "grep": lambda m: (lambda s: m.push(" ".join(o for o in sorted(OPERATORS) if s in o)))(m.pop(str)),
    "dgt": _digits,
    "vb": lambda m: m.spark.sparkContext.setLogLevel("INFO" if m.pop(int) else "ERROR"),
    "quit": _quit,
}
# fixed values: short names
OPERATORS |= {short: OPERATORS[name] for short, name in {"d": "def", "x": "exch", "i": "info", "p": "pop", "f": "free", "u": "unlink", "l": "list", "h": "help", "bye": "quit", "g": "grep"}.items()}


def run(spark: SparkSession, program: str, names: dict[str, Any] | None = None) -> list[Any]:
    """The stack a program leaves, its top last."""
    return Machine(spark, names).run(program)
