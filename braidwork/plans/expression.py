"""Expressions over several sets: a lexer, a parser by recursive descent, and definition files."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.sets import COUNTER_RULES, KmerSet, Limits, combined, grouped, limits_of

_TOKEN = re.compile(r"\s*(?:(?P<name>\w+)|(?P<sign>[-+~*()])|(?P<bad>\S))")
_OPERATIONS = {"+": "union", "-": "kmers_subtract", "~": "counters_subtract", "*": "intersect"}


@dataclass(frozen=True)
class Node:
    """An operation on two operands, or, without a sign, a set by name."""

    sign: str = ""
    rule: str | None = None
    left: Node | None = None
    right: Node | None = None
    name: str = ""

    def evaluate(self, sets: dict[str, KmerSet]) -> KmerSet:
        """All sets are grouped by k-mer in one shuffle, their counters side by side; the tree is one expression of these, each node within its limits."""
        if not self.sign:
            return sets[self.name]
        used = {n: sets[n] for n in sorted(self.names())}
        at = {n: F.col(f"_bw_{i}") for i, n in enumerate(used)}
        count, limits = self._counter(used, at)
        first = next(iter(used.values()))
        rows = grouped({f"_bw_{i}": s for i, s in enumerate(used.values())}).select(*first.words, count.alias("cnt")).where("cnt IS NOT NULL")
        return KmerSet(rows, first.k, any(s.both_strands for s in used.values()), limits.ci, limits.cx, limits.size)

    def _counter(self, sets: dict[str, KmerSet], at: dict[str, Column]) -> tuple[Column, KmerSet | Limits]:
        if not self.sign:
            return at[self.name], sets[self.name]
        (l, a), (r, b) = self.left._counter(sets, at), self.right._counter(sets, at)  # noqa: E741
        limits = limits_of(a, b)
        return limits.of(combined(_OPERATIONS[self.sign], self.rule, l, r)), limits

    def names(self) -> set[str]:
        return self.left.names() | self.right.names() if self.sign else {self.name}


def tokens(text: str) -> list[str]:
    """Names and signs; anything else is an error, as is a word that only begins like a rule."""
    found = []
    for m in _TOKEN.finditer(text):
        if m["bad"]:
            raise ValueError(f"unexpected {m['bad']!r} in {text!r}")
        found.append(m["name"] or m["sign"])
    return found


def parse(text: str) -> Node:
    """``*`` binds closer than ``+``, ``-`` and ``~``; equals are taken from the left; a rule may follow any sign but ``-``."""
    left = tokens(text)

    def take() -> str:
        if not left:
            raise ValueError(f"{text!r} ends too early")
        return left.pop(0)

    def chain(signs: str, operand: Callable[[], Node]) -> Node:
        node = operand()
        while left and left[0] in signs:
            sign, rule = take(), None
            if left and left[0] in COUNTER_RULES:
                rule = take()
                if sign == "-":
                    raise ValueError("no counter rule goes with -")
            node = Node(sign, rule, node, operand())
        return node

    def single() -> Node:
        word = take()
        if word == "(":
            node = chain("+-~", product)
            if take() != ")":
                raise ValueError(f"a ) is missing in {text!r}")
            return node
        if not re.fullmatch(r"\w+", word) or word in COUNTER_RULES:
            raise ValueError(f"a name is missing before {word!r}")
        return Node(name=word)

    def product() -> Node:
        return chain("*", single)

    node = chain("+-~", product)
    if left:
        raise ValueError(f"unexpected {left[0]!r} in {text!r}")
    return node


def evaluate(text: str, sets: dict[str, KmerSet]) -> KmerSet:
    node = parse(text)
    if unknown := node.names() - set(sets):
        raise ValueError(f"unknown sets: {', '.join(sorted(unknown))}")
    return node.evaluate(sets)


@dataclass(frozen=True)
class Definition:
    """A parsed definition: sets by name with path and cutoffs, the outcome's path, its expression and limits."""

    inputs: dict[str, tuple[str, dict[str, int]]]
    output: str
    expression: Node
    limits: dict[str, int]

    def run(self, open_set: Callable[..., KmerSet]) -> KmerSet:
        sets = {n: open_set(path, **cut) for n, (path, cut) in self.inputs.items()}
        return self.expression.evaluate(sets).reduce(**self.limits) if self.limits else self.expression.evaluate(sets)


_OPTION = re.compile(r"-(ci|cx|cs)(\d+)")


def parse_definition(text: str) -> Definition:
    """The three parts INPUT:, OUTPUT: and, if wanted, OUTPUT_PARAMS:, a line each entry.

    An input is ``name = path`` with -ci and -cx after it, the output ``path = expression``, limits
    are any of -ci, -cx and -cs.
    """
    part, inputs, output, limits = "", {}, None, {}
    for line in map(str.strip, text.splitlines()):
        if not line:
            continue
        if line in ("INPUT:", "OUTPUT:", "OUTPUT_PARAMS:"):
            part = line
        elif part == "INPUT:":
            m = re.fullmatch(r"(\w+)\s*=\s*(\S+)((?:\s+-c[ix]\d+)*)", line)
            if not m:
                raise ValueError(f"no input: {line!r}")
            if m[1] in inputs:
                raise ValueError(f"{m[1]} is named twice")
            inputs[m[1]] = (m[2], {a: int(b) for a, b in _OPTION.findall(m[3])})
        elif part == "OUTPUT:":
            path, sign, expression = line.partition("=")
            if not sign or output:
                raise ValueError(f"no output, or a second one: {line!r}")
            output = (path.strip(), parse(expression))
        elif part == "OUTPUT_PARAMS:":
            if _OPTION.sub("", line).strip():
                raise ValueError(f"no limits: {line!r}")
            limits |= {a: int(b) for a, b in _OPTION.findall(line)}
        else:
            raise ValueError(f"{line!r} stands in no part")
    if not output or not inputs:
        raise ValueError("a definition has inputs and one output")
    if unknown := output[1].names() - set(inputs):
        raise ValueError(f"unknown sets: {', '.join(sorted(unknown))}")
    return Definition(inputs, output[0], output[1], limits)
