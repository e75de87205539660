"""A small sandboxed template language, compiled to Python closures.

``Template(source)`` parses to a syntax tree, folds constants and makes one closure a node. Rendering is a stream: each
run of text comes as ``(text, generated)``, and ``messages`` may be any iterator, so a conversation of any length
renders in the memory of its longest turn.

Syntax: ``{{ expr }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in y %} {% endfor %}`` (with
``loop.index``, ``loop.index0``, ``loop.first``, ``loop.last``), ``{% set x = expr %}``, ``{% generation %} {% endgeneration %}``
around what the model is to learn, ``{# comment #}`` and ``-`` beside a brace to strip white space. Expressions have
literals, lists, names, ``a.b``, ``a[b]``, ``a | filter(x)``, ``+ - * / // % ~``, comparisons, ``in``, ``and or not`` and
``a if t else b``. There are no calls, no Python attributes and no names that start with an underscore.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

Rendered = Iterable[tuple[str, bool]]


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    base: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """A filter or an operator: a pure function of its operands."""

    what: str
    operands: tuple


@dataclass(frozen=True)
class Choice:
    """``and``, ``or`` and the conditional expression: not all operands are evaluated."""

    kind: str
    operands: tuple


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


#: No computed string or list is longer, no computed whole number larger.
LONGEST, LARGEST = 1 << 24, 1 << 63


def bounded(value: Any) -> Any:
    if isinstance(value, (str, list, tuple)) and len(value) > LONGEST or isinstance(value, int) and abs(value) > LARGEST:
        raise TemplateError("a value grows too large")
    return value


def times(a: Any, b: Any) -> Any:
    for x, n in ((a, b), (b, a)):
        if isinstance(x, (str, list, tuple)) and isinstance(n, int) and len(x) * n > LONGEST:
            raise TemplateError("a value grows too large")
    return bounded(a * b)


def replaced(x: Any, old: str, new: str) -> str:
    text = shown(x)
    if text.count(old) * len(new) > LONGEST:
        raise TemplateError("a value grows too large")
    return text.replace(old, new)


def remainder(a: Any, b: Any) -> Any:
    if isinstance(a, str):
        raise TemplateError("a text has no remainder")
    return a % b


BINARY = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "+": lambda a, b: bounded(a + b), "-": operator.sub, "*": times, "/": operator.truediv, "//": operator.floordiv, "%": remainder,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "~": lambda a, b: bounded(shown(a) + shown(b)),
}
LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "/", "//", "%"))
FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "length": len,
    "default": lambda x, other="": other if x is None else x, "replace": replaced, "join": lambda x, by="": bounded(by.join(map(shown, x))),
    "string": lambda x: shown(x),
}
TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<op>==|!=|<=|>=|//|[-+*/%~<>|.,:()\[\]=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
TAG = re.compile(r"""\{\#(?P<before>-?).*?(?P<after>-?)\#\}|\{(?P<open>[{%])(?P<left>-?)(?P<body>(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?)(?P<right>-?)(?P<close>[}%])\}""", re.S)


def shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


class Expressions:
    """Precedence climbing over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(source.rstrip())
        while at < end:
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"unexpected text: {source[at : at + 20]!r}")
            kind = m.lastgroup or ""
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind != "string" and value in values and value:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"not a usable name: {value!r}")
        self.at += 1
        return value

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.peek()[1]!r}")

    def expr(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Choice("if", (test, value, self.expr()))
        return value

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Choice("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Choice("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.take("not") else self.binary(0)

    def binary(self, level: int) -> Any:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            if self.peek() == ("name", "not") and self.peek(1) == ("name", "in") and "not in" in LEVELS[level]:
                self.at += 2
                op: str | None = "not in"
            else:
                op = self.take(*LEVELS[level])
            if not op:
                return left
            left = Apply(op, (left, self.binary(level + 1)))

    def unary(self) -> Any:
        return Apply("negate", (self.unary(),)) if self.take("-") else self.postfix()

    def postfix(self) -> Any:
        value = self.primary()
        while True:
            if self.take("."):
                value = Item(value, Const(self.name()))
            elif self.take("["):
                value = Item(value, self.expr())
                self.need("]")
            elif self.take("|"):
                filter_name, rest = self.name(), []
                if self.take("("):
                    while not self.take(")"):
                        rest.append(self.expr())
                        self.take(",")
                value = Apply(f"|{filter_name}", (value, *rest))
            else:
                return value

    def primary(self) -> Any:
        kind, value = self.peek()
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return Apply("list", tuple(items))
        self.at += 1
        if kind == "number":
            return Const(float(value) if "." in value else int(value))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            low = value.lower()
            if low in ("true", "false", "none"):
                return Const({"true": True, "false": False, "none": None}[low])
            self.at -= 1
            return Name(self.name())
        raise TemplateError(f"unexpected {value!r}")


def cut(source: str) -> list[tuple[str, str]]:
    """Text and tags in order; ``-`` strips the text beside it."""
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in TAG.finditer(source):
        if m["open"] and {"{": "}", "%": "%"}[m["open"]] != m["close"]:
            raise TemplateError(f"tag closed by another brace: {m[0]!r}")
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if m["left"] or m["before"] else text))
        if m["open"]:
            out.append(("output" if m["open"] == "{" else "tag", m["body"].strip()))
        at, strip = m.end(), bool(m["right"] or m["after"])
    out.append(("text", source[at:].lstrip() if strip else source[at:]))
    if unclosed := next((x for kind, x in out if kind == "text" and re.search(r"\{[{%#]", x)), None):
        raise TemplateError(f"tag without an end: {unclosed[:40]!r}")
    return [x for x in out if x != ("text", "")]


def parse(source: str) -> tuple:
    parts, at = cut(source), 0

    def block(*ends: str) -> tuple[tuple, str, Expressions | None]:
        nonlocal at
        out: list = []
        while at < len(parts):
            kind, body = parts[at]
            at += 1
            if kind == "text":
                out.append(Output(Const(body)))
                continue
            e = Expressions(body)
            if kind == "output":
                out.append(Output(e.expr()))
                e.done()
                continue
            word = e.name()
            if word in ends:
                return tuple(out), word, e
            if word == "if":
                out.append(branch(e))
            elif word == "for":
                name = e.name()
                e.need("in")
                over = e.expr()
                e.done()
                out.append(For(name, over, block("endfor")[0]))
            elif word == "set":
                name = e.name()
                e.need("=")
                out.append(Assign(name, e.expr()))
                e.done()
            elif word == "generation":
                out.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), "", None

    def branch(e: Expressions) -> If:
        test = e.expr()
        e.done()
        then, word, following = block("elif", "else", "endif")
        if word == "elif":
            return If(test, then, (branch(following),))
        return If(test, then, block("endif")[0] if word == "else" else ())

    return block()[0]


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with what is known beforehand computed, dead branches gone and neighbouring texts joined.

    Branches that are never taken are not looked at, and what can't be computed stays to fail when it is reached.
    """
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x, filters)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.expr, Const):
                    text = shown(y.expr.value)
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                        text = out.pop().expr.value + text
                    if text:
                        out.append(Output(Const(text)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Apply):
        f = function(node.what, filters) if node.what != "list" else None
        operands = tuple(fold(x, filters) for x in node.operands)
        if f and all(isinstance(x, Const) for x in operands):
            try:
                return Const(f(*(x.value for x in operands)))
            except (ArithmeticError, TypeError, ValueError):
                pass
        return Apply(node.what, operands)
    if isinstance(node, Choice):
        first = fold(node.operands[0], filters)
        if not isinstance(first, Const):
            return Choice(node.kind, (first, *(fold(x, filters) for x in node.operands[1:])))
        if node.kind == "if":
            return fold(node.operands[1 if first.value else 2], filters)
        return fold(node.operands[1], filters) if bool(first.value) == (node.kind == "and") else first
    if isinstance(node, Item):
        return Item(fold(node.base, filters), fold(node.key, filters))
    if isinstance(node, Output):
        return Output(fold(node.expr, filters))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.expr, filters))
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def function(what: str, filters: Mapping[str, Callable]) -> Callable:
    if what.startswith("|"):
        if what[1:] not in filters:
            raise TemplateError(f"unknown filter {what[1:]!r}")
        return filters[what[1:]]
    return {"not": operator.not_, "negate": operator.neg, "list": lambda *x: list(x)}.get(what) or BINARY[what]


def item(base: Any, key: Any) -> Any:
    """Entries of mappings and lists only; anything else, and what is missing, is none."""
    if isinstance(base, Mapping):
        return base.get(key)
    if isinstance(base, (list, tuple, str)) and isinstance(key, int):
        return base[key] if -len(base) <= key < len(base) else None
    return None


def value_closure(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        base, key = value_closure(node.base, filters), value_closure(node.key, filters)
        return lambda env: item(base(env), key(env))
    parts = [value_closure(x, filters) for x in node.operands]
    if isinstance(node, Choice):
        if node.kind == "if":
            test, yes, no = parts
            return lambda env: yes(env) if test(env) else no(env)
        left, right = parts
        return (lambda env: left(env) and right(env)) if node.kind == "and" else (lambda env: left(env) or right(env))
    f = function(node.what, filters)
    if len(parts) == 1:
        only = parts[0]
        return lambda env: f(only(env))
    return lambda env: f(*[p(env) for p in parts])


def statement_closure(node: Any, filters: Mapping[str, Callable], generated: bool) -> Callable[[dict], Rendered]:
    """A closure that yields the node's text run by run, each with whether it is generated."""
    if isinstance(node, tuple):
        steps = [statement_closure(x, filters, generated) for x in node]

        def run_all(env: dict) -> Rendered:
            for step in steps:
                yield from step(env)

        return run_all
    if isinstance(node, Output):
        value = value_closure(node.expr, filters)
        return lambda env: ((shown(value(env)), generated),)
    if isinstance(node, Assign):
        value = value_closure(node.expr, filters)
        return lambda env: env.__setitem__(node.name, value(env)) or ()
    if isinstance(node, Generation):
        return statement_closure(node.body, filters, True)
    if isinstance(node, If):
        test = value_closure(node.test, filters)
        then, other = (statement_closure(x, filters, generated) for x in (node.then, node.other))
        return lambda env: then(env) if test(env) else other(env)
    over, body = value_closure(node.over, filters), statement_closure(node.body, filters, generated)

    def loop(env: dict) -> Rendered:
        kept = {k: env.get(k) for k in (node.name, "loop")}
        for i, (value, last) in enumerate(with_last(over(env) or ())):
            env[node.name] = value
            env["loop"] = {"index": i + 1, "index0": i, "first": not i, "last": last}
            yield from body(env)
        env.update(kept)

    return loop


def with_last(items: Iterable) -> Iterator[tuple[Any, bool]]:
    """Each item and whether it is the last, reading one ahead."""
    it = iter(items)
    for held in it:
        for following in it:
            yield held, False
            held = following
        yield held, True


@dataclass
class Template:
    """A compiled template. ``controls`` are the strings that no text may hold; the filter ``guard`` escapes them."""

    source: str
    controls: tuple[str, ...] = ()
    tree: tuple = field(init=False, repr=False)

    def __post_init__(self) -> None:
        filters = FILTERS | {"guard": Guard(self.controls).escape}
        self.tree = fold(parse(self.source), filters)
        self._run = statement_closure(self.tree, filters, False)

    def stream(self, **names: Any) -> Rendered:
        return self._run(dict(names))

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans (code points) of what is generated."""
        out: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for text, generated in self.stream(**names):
            out.append(text)
            if generated and text:
                spans.append((at, at + len(text)))
            at += len(text)
        return "".join(out), spans


class Guard:
    """Reversible escaping of control strings.

    A control string is a first character and a rest that doesn't hold any control's first character. Wherever a text
    has the first, any number of backslashes and the rest, escaping adds one backslash and unescaping takes one away. So an
    escaped text holds no control string and every text comes back exactly.
    """

    def __init__(self, controls: tuple[str, ...]):
        firsts = {c[0] for c in controls}
        if any(len(c) < 2 or c[1] == "\\" or set(c[1:]) & firsts for c in controls):
            raise TemplateError("a control string has two characters at least, and its first one nowhere else")
        gapped = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in sorted(controls, key=len, reverse=True))
        self._any = re.compile(gapped) if gapped else None

    def escape(self, text: Any) -> str:
        text = shown(text)
        return self._any.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if self._any else text

    def unescape(self, text: str) -> str:
        return self._any.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text) if self._any else text
