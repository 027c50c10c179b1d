"""Formulas: expression trees over features, as prefix text, Spark columns, numpy arrays or infix text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from ..functions import safe

#: Named constants of formulas.
CONSTANTS = {"zero": 0.0, "one": 1.0, "neg_one": -1.0, "half": 0.5, "tenth": 0.1, "hundredth": 0.01}


def _finite(x):
    return np.where(np.isfinite(x), x, 0.0)


@dataclass(frozen=True)
class Op:
    arity: int
    column: Callable[..., Column]
    array: Callable[..., np.ndarray]
    infix: str


OPS: dict[str, Op] = {
    "add": Op(2, safe.add, lambda a, b: a + b, "({} + {})"),
    "sub": Op(2, safe.sub, lambda a, b: a - b, "({} - {})"),
    "mul": Op(2, safe.mul, lambda a, b: a * b, "({} * {})"),
    "div": Op(2, safe.div, lambda a, b: np.where(np.abs(b) < 1e-8, 0.0, a / np.where(b == 0, 1.0, b)), "({} / {})"),
    "max": Op(2, safe.greater, np.fmax, "({} max {})"),
    "min": Op(2, safe.lesser, np.fmin, "({} min {})"),
    "neg": Op(1, safe.neg, lambda a: -a, "(-{})"),
    "exp": Op(1, safe.exp, lambda a: np.where(a > 10, 1.0, np.exp(np.minimum(a, 10))), "exp({})"),
    "log": Op(1, safe.log, lambda a: np.where(a <= 0, 0.0, np.log(np.where(a <= 0, 1.0, a))), "log({})"),
    "sqrt": Op(1, safe.sqrt, lambda a: np.where(a < 0, 0.0, np.sqrt(np.maximum(a, 0))), "sqrt({})"),
}


@dataclass(frozen=True)
class Node:
    """An operator with its arguments, or a terminal: a feature, a named constant or a number."""

    name: str
    args: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})" if self.args else self.name

    def size(self) -> int:
        return 1 + sum(a.size() for a in self.args)

    def height(self) -> int:
        return 1 + max(a.height() for a in self.args) if self.args else 0

    def nodes(self) -> Iterator[Node]:
        yield self
        for a in self.args:
            yield from a.nodes()

    def replaced(self, at: int, by: Node) -> Node:
        """The tree with the node at a place, in prefix order, replaced."""
        if at == 0:
            return by
        at, args = at - 1, list(self.args)
        for i, a in enumerate(args):
            n = a.size()
            if at < n:
                args[i] = a.replaced(at, by)
                break
            at -= n
        return Node(self.name, tuple(args))

    def number(self) -> float | None:
        if self.args:
            return None
        if self.name in CONSTANTS:
            return CONSTANTS[self.name]
        try:
            return float(self.name)
        except ValueError:
            return None

    def features(self) -> set[str]:
        return {n.name for n in self.nodes() if not n.args and n.number() is None}


_TOKEN = re.compile(r"\s*([A-Za-z_]\w*|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def parse(text: str, features: set[str] | None = None) -> Node:
    """A tree of prefix text such as ``sub(rsi_7, half)``; ValueError for anything else or for unknown features."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.append("")

    def read(i: int) -> tuple[Node, int]:
        name = tokens[i]
        if not name or name in "(),":
            raise ValueError(f"unexpected {name!r}")
        if tokens[i + 1] != "(":
            node = Node(name)
            if name in OPS or (features is not None and node.number() is None and name not in features):
                raise ValueError(f"unknown terminal {name!r}")
            return node, i + 1
        if name not in OPS:
            raise ValueError(f"unknown operator {name!r}")
        args, i = [], i + 1
        while tokens[i] in ("(", ","):
            arg, i = read(i + 1)
            args.append(arg)
        if tokens[i] != ")" or len(args) != OPS[name].arity:
            raise ValueError(f"{name} takes {OPS[name].arity} arguments")
        return Node(name, tuple(args)), i + 1

    node, end = read(0)
    if tokens[end]:
        raise ValueError(f"unexpected {tokens[end]!r}")
    return node


def column(tree: Node | str) -> Column:
    """The formula as a Spark column, without user functions; null, NaN and infinite features are zero."""
    tree = parse(tree) if isinstance(tree, str) else tree
    if tree.args:
        return OPS[tree.name].column(*map(column, tree.args))
    value = tree.number()
    return F.lit(value) if value is not None else safe.finite(F.col(tree.name).cast("double"))


def evaluate(tree: Node, features: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The formula over whole arrays of n rows: the evaluator for many formulas over the same rows."""
    with np.errstate(all="ignore"):
        if tree.args:
            return _finite(OPS[tree.name].array(*(evaluate(a, features, n) for a in tree.args)))
        value = tree.number()
        return np.full(n, value) if value is not None else _finite(features[tree.name].astype(np.float64))


#: Operators whose arguments may change places.
COMMUTATIVE = frozenset({"add", "mul", "max", "min"})


def normal(tree: Node) -> Node:
    """The tree with arguments of commutative operators in order, and numbers by value: equal for formulas that differ in that alone.

    It has the size of the tree, and the same signal.
    """
    value = tree.number()
    if value is not None:
        return Node(repr(value))
    args = tuple(normal(a) for a in tree.args)
    return Node(tree.name, tuple(sorted(args, key=str)) if tree.name in COMMUTATIVE else args)


class Graph:
    """Formulas as one graph, in which each distinct subtree is one node, however many formulas hold it.

    Nodes come after their arguments; trees that are equal but for the order of commutative arguments have one root.
    """

    def __init__(self, trees: list[Node]):
        self._ids: dict[tuple, int] = {}
        self.nodes: list[tuple[Node, tuple[int, ...]]] = []
        self.roots: dict[int, list[int]] = {}
        for i, tree in enumerate(trees):
            self.roots.setdefault(self._add(tree), []).append(i)
        self._uses = [0] * len(self.nodes)
        for _, args in self.nodes:
            for a in args:
                self._uses[a] += 1

    def _add(self, tree: Node) -> int:
        args = tuple(self._add(a) for a in tree.args)
        if tree.name in COMMUTATIVE:
            args = tuple(sorted(args))
        value = tree.number()
        key = (tree.name, args) if value is None else (repr(value), None)
        if key not in self._ids:
            self._ids[key] = len(self.nodes)
            self.nodes.append((tree, args))
        return self._ids[key]

    def __len__(self) -> int:
        return len(self.nodes)

    def signals(self, features: dict[str, np.ndarray], n: int) -> Iterator[tuple[list[int], np.ndarray]]:
        """(numbers of the trees, their signal over n rows), root by root: each node is computed once and kept until its last use."""
        left, values = list(self._uses), {}
        for i, (tree, args) in enumerate(self.nodes):
            with np.errstate(all="ignore"):
                values[i] = _finite(OPS[tree.name].array(*(values[a] for a in args))) if args else evaluate(tree, features, n)
            if i in self.roots:
                yield self.roots[i], values[i]
            for a in args:
                left[a] -= 1
                if not left[a]:
                    values.pop(a, None)
            if not left[i]:
                del values[i]


def infix(tree: Node | str) -> str:
    tree = parse(tree) if isinstance(tree, str) else tree
    return OPS[tree.name].infix.format(*map(infix, tree.args)) if tree.args else tree.name


def diverse(df, tree: Node | str, least: float = 0.01, rows: int = 500):
    """One row: the spread of the squashed signal over a repeatable sample of rows, and whether that is enough."""
    sample = df.orderBy(F.xxhash64("symbol", "date"), "symbol", "date").limit(rows)  # a sampling operator
    out = sample.agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop(F.tanh(column(tree))), F.lit(0.0)).alias("spread"))
    return out.withColumn("diverse", (F.col("n") >= 10) & (F.col("spread") >= least))
