"""Conditions over a match, compiled to Columns.

    or   := and (OR and)*            and  := not (AND not)*        not := NOT not | comparison
    comparison := sum [(>= | <= | != | > | < | ==) sum]
    sum  := product ((+ | -) product)*      product := atom ((* | /) atom)*
    atom := number | "text" | symbol.property | ( or )

A property is text. Where it is a number and meets a number, both are compared and computed as numbers; otherwise as
texts, in which a number never equals a text. A missing property is the empty text. Division by zero gives null, and
a condition that is null doesn't hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<text>"[^"]*"|'[^']*')|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(?P<sign>>=|<=|!=|==|[-+*/()<>]))""")


class ConditionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple[Node, ...] = ()

    def references(self) -> set[tuple[str, str]]:
        """(symbol, property) that occur."""
        own = {tuple(self.value.split(".", 1))} if self.kind == "property" else set()
        return own.union(*(p.references() for p in self.parts)) if self.parts else own

    def conjuncts(self) -> list[Node]:
        return [c for p in self.parts for c in p.conjuncts()] if self.kind == "and" else [self]


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ConditionError(f"can't read the condition from: {text[at:]}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ConditionError("the condition ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self, below, signs: tuple[str, ...], kind) -> Node:
        node = below()
        while self.peek() in signs:
            sign = self.take()[1]
            node = Node(kind or sign.lower(), sign, (node, below()))
        return node

    def any_(self) -> Node:
        return self.chain(self.all_, ("OR",), None)

    def all_(self) -> Node:
        return self.chain(self.not_, ("AND",), None)

    def not_(self) -> Node:
        if self.peek() == "NOT":
            self.take()
            return Node("not", None, (self.not_(),))
        node = self.sum_()
        if self.peek() in (">=", "<=", "!=", ">", "<", "=="):
            sign = self.take()[1]
            return Node("compare", sign, (node, self.sum_()))
        return node

    def sum_(self) -> Node:
        return self.chain(lambda: self.chain(self.atom, ("*", "/"), "compute"), ("+", "-"), "compute")

    def atom(self) -> Node:
        kind, value = self.take()
        if value == "(":
            node = self.any_()
            if self.take()[1] != ")":
                raise ConditionError("a parenthesis isn't closed")
            return node
        if kind == "number":
            return Node("number", float(value))
        if kind == "text":
            return Node("text", value[1:-1])
        if kind == "name" and "." in value:
            return Node("property", value)
        raise ConditionError(f"unexpected {value}")


def parse(text: str) -> Node:
    parser = _Parser(text)
    node = parser.any_()
    if parser.peek() is not None:
        raise ConditionError(f"unexpected {parser.peek()}")
    _expect(node, True)
    return node


def _expect(node: Node, truth: bool) -> None:
    if truth != (node.kind in ("and", "or", "not", "compare")):
        raise ConditionError("a value stands where a condition should, or a condition where a value should")
    for p in node.parts:
        _expect(p, node.kind in ("and", "or", "not"))


def _number(node: Node, column) -> Column:
    if node.kind == "number":
        return F.lit(node.value)
    if node.kind == "compute":
        a, b = (_number(p, column) for p in node.parts)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[node.value]()
    text = F.lit(node.value) if node.kind == "text" else column(*node.value.split(".", 1))
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def _text(node: Node, column) -> Column:
    """What a value is as text; null where it is a number by itself."""
    if node.kind == "text":
        return F.lit(node.value)
    return column(*node.value.split(".", 1)) if node.kind == "property" else F.lit(None).cast("string")


def compile_(node: Node, column) -> Column:
    """column(symbol, property) gives the Column of a property, as text."""
    if node.kind in ("and", "or"):
        a, b = (compile_(p, column) for p in node.parts)
        return a & b if node.kind == "and" else a | b
    if node.kind == "not":
        return ~compile_(node.parts[0], column)
    (a, b), sign = node.parts, node.value
    compare = {">=": Column.__ge__, "<=": Column.__le__, "!=": Column.__ne__, ">": Column.__gt__, "<": Column.__lt__, "==": Column.__eq__}[sign]
    x, y = _number(a, column), _number(b, column)
    s, t = _text(a, column), _text(b, column)
    as_text = compare(s, t)
    other = F.lit({"==": False, "!=": True}.get(sign)).cast("boolean")
    if "compute" in (a.kind, b.kind) and "/" not in _signs(node):
        return F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).otherwise(other)
    if "compute" in (a.kind, b.kind):
        return compare(x, y)
    return F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).when(s.isNotNull() & t.isNotNull(), as_text).otherwise(other)


def _signs(node: Node) -> set:
    return {node.value, *(s for p in node.parts for s in _signs(p))} if node.kind in ("compute", "compare") else set()
