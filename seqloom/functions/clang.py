"""C source: tokens with types, function signatures, and a printer of tokens.

The lexer has its own grammar: keywords (type: the word in capitals), identifiers (``ID``), integer, floating, character and string
constants (``L"..."`` is ``WSTRING_LITERAL``), operators and punctuation. Comments, preprocessor lines and white space are skipped;
a character that starts no token is skipped too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.functions.slices import row_by_row

#: The language's keywords, in alphabetical order.
KEYWORDS = frozenset((
    "_Bool", "_Complex", "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if", "inline", "int", "long", "register",
    "restrict", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while",
))
#: Operators and punctuation, longest first.
SYMBOLS = ("...", "<<=", ">>=", "->", "++", "--", "<<", ">>", "<=", ">=", "==", "!=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", *"{}()[];,.:?~!%^&*-+=<>|/")
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*\#[^\n]*)
    |(?P<WSTRING_LITERAL>L"(?:[^"\\\n]|\\.)*")|(?P<STRING_LITERAL>"(?:[^"\\\n]|\\.)*")
    |(?P<WCHAR_CONST>L'(?:[^'\\\n]|\\.)+')|(?P<CHAR_CONST>'(?:[^'\\\n]|\\.)+')
    |(?P<ID>[A-Za-z_$][\w$]*)
    |(?P<FLOAT_CONST>0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?\d+[fFlL]?|(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[fFlL]?|\d+[eE][+-]?\d+[fFlL]?)
    |(?P<INT_CONST_HEX>0[xX][0-9a-fA-F]+[uUlL]*)|(?P<INT_CONST_BIN>0[bB][01]+[uUlL]*)|(?P<INT_CONST_OCT>0[0-7]*[uUlL]*)|(?P<INT_CONST_DEC>[1-9]\d*[uUlL]*)
    |(?P<SYMBOL>"""
    + "|".join(map(re.escape, SYMBOLS))
    + ")",
    re.X | re.S | re.M,
)
LEXED = "array<struct<type:string,value:string>>"
TYPE = "struct<type:array<string>,pointer_layer:int>"
SIGNATURE = f"struct<parsable:boolean,name:string,ret_type:{TYPE},args:array<struct<type:array<string>,pointer_layer:int,name:string>>>"


def lex(code: str) -> list[tuple[str, str]]:
    """(type, value) of each token; ``<unk>`` counts as part of an identifier."""
    out = []
    for m in _TOKEN.finditer(code.replace("<unk>", "__unk__")):
        kind, value = m.lastgroup or "", m[0]
        if kind != "skip":
            out.append((value.upper() if kind == "ID" and value in KEYWORDS else kind, value))
    return out


def values(code: str) -> list[str]:
    return [v for _, v in lex(code)]


def head(code: str) -> list[str]:
    """The values up to the first brace that opens a body: all that a lenient ``signature`` looks at."""
    out = []
    for m in _TOKEN.finditer(code.replace("<unk>", "__unk__")):
        if m.lastgroup != "skip":
            out.append(m[0])
            if m[0] == "{":
                break
    return out


class Unparsable(ValueError):
    pass


@dataclass(frozen=True)
class Declared:
    type: tuple[str, ...]
    pointer_layer: int
    name: str


@dataclass(frozen=True)
class Signature:
    returns: Declared
    args: tuple[Declared, ...]

    @property
    def name(self) -> str:
        return self.returns.name


CLOSER = {"{": "}", "(": ")", "[": "]"}


@dataclass
class Nest:
    """What a pair of brackets holds: positions of tokens and further nests. ``stop`` is None while the bracket is open."""

    kind: str
    start: int
    stop: int | None = None
    items: list[int | Nest] = field(default_factory=list)


def nested(tokens: list[str]) -> list[int | Nest]:
    """The tokens' positions as a tree of brackets, in one pass. A closing bracket that fits no open one is a plain token."""
    root = Nest("", -1)
    path = [root]
    for at, token in enumerate(tokens):
        if token in CLOSER:
            inner = Nest(token, at)
            path[-1].items.append(inner)
            path.append(inner)
        elif token == CLOSER.get(path[-1].kind):
            path.pop().stop = at
        else:
            path[-1].items.append(at)
    return root.items


def positions(items: Iterable[int | Nest], into: str) -> Iterator[int]:
    """Positions of the tokens among ``items``, and of those within nests of the kinds ``into``."""
    for x in items:
        if isinstance(x, int):
            yield x
        elif x.kind in into:
            yield from positions(x.items, into)


def spelt(tokens: list[str], items: Iterable[int | Nest]) -> Iterator[int]:
    """Positions of all tokens but those that square brackets hold."""
    for x in items:
        if isinstance(x, int):
            yield x
            continue
        yield x.start
        if x.kind != "[":
            yield from spelt(tokens, x.items)
        if x.stop is not None:
            yield x.stop


def pieces(tokens: list[str], items: list[int | Nest], by: str) -> list[list[int | Nest]]:
    """``items`` cut at the separators of their own level."""
    out: list[list[int | Nest]] = [[]]
    for x in items:
        if isinstance(x, int) and tokens[x] == by:
            out.append([])
        else:
            out[-1].append(x)
    return out


def declaration(tokens: list[str], items: list[int | Nest]) -> Declared:
    """Specifiers and one declarator.

    A parenthesised declarator (``( * f ) ( int )``) names what stands first in its parentheses; a plain one ends with the
    name. All else is the type, arrays without their sizes; stars on the way to the name are layers of pointers.
    """
    if [tokens[x] for x in items if isinstance(x, int)] == ["..."] and len(items) == 1:
        return Declared(("...",), 0, "...")
    wrapped = next((x for x in items if isinstance(x, Nest) and x.kind == "("), None)
    words = [x for x in positions(items if wrapped is None else wrapped.items, "" if wrapped is None else "(") if tokens[x].isidentifier()]
    if not words:
        raise Unparsable("no name")
    name = words[-1] if wrapped is None else words[0]
    first = items[0] if isinstance(items[0], int) else items[0].start
    return Declared(tuple(tokens[x] for x in spelt(tokens, items) if x != name), tokens[first:name].count("*"), tokens[name])


def signature(tokens: list[str], strict: bool = True) -> Signature:
    """A function's declarator: what it returns, its name and its parameters, listed in parentheses or, in the old style, declared
    between them and the body. Strict: the last token closes the body. Lenient: the body starts at the first brace."""
    if strict:
        head = nested(tokens)
        body = head.pop() if head else None
        if not isinstance(body, Nest) or body.kind != "{" or body.stop is None:
            raise Unparsable("no body at the end")
        if any(tokens[x] in CLOSER.values() for x in positions(body.items, "{([")):
            raise Unparsable("brackets of the body don't nest")
    elif "{" in tokens:
        head = nested(tokens[: tokens.index("{")])
    else:
        raise Unparsable("no body")
    at = next((k for k in reversed(range(len(head))) if isinstance(head[k], Nest) and head[k].kind == "("), None)
    if at is None or head[at].stop is None:
        raise Unparsable("no parameters")
    returns, listed, old_style = declaration(tokens, head[:at]), head[at].items, head[at + 1 :]
    if not returns.type:
        returns = Declared(("void",), 0, returns.name)
    if not listed or [tokens[x] for x in positions(listed, "{[(")] == ["void"]:
        return Signature(returns, ())
    declarations = pieces(tokens, old_style, ";")[:-1] if old_style else pieces(tokens, listed, ",")
    return Signature(returns, tuple(declaration(tokens, d) for d in declarations))


EMPTY = Signature(Declared(("",), 0, ""), ())


def parsed(tokens: list[str], strict: bool = True) -> tuple[Signature, bool]:
    """The signature and whether there is one; code that can't be parsed has an empty one."""
    try:
        return signature(tokens, strict), True
    except (Unparsable, IndexError):
        return EMPTY, False


#: Tokens without a space after them, without one before them, and pairs without one between them.
TIGHT_AFTER = frozenset(("(", "!", "~", "[", ".", "->"))
TIGHT_BEFORE = frozenset((")", ";", ",", "[", "]", ".", "->"))
TIGHT_BETWEEN = frozenset(((")", "("), ("*", "*")))


def line_of(tokens: list[str]) -> str:
    """Tokens side by side; a call's parenthesis follows its name at once."""
    out = tokens[:1]
    for left, right in pairwise(tokens):
        call = right == "(" and left.isidentifier() and left not in KEYWORDS
        out.append(right if call or left in TIGHT_AFTER or right in TIGHT_BEFORE or (left, right) in TIGHT_BETWEEN else f" {right}")
    return "".join(out)


def prettify(tokens: list[str]) -> str:
    """Lines that end at braces and at semicolons outside parentheses, indented by open braces. What follows the last such end
    isn't shown."""
    weigh = lambda up, down: list(accumulate((t == up) - (t == down) for t in tokens))
    open_parens, following = weigh("(", ")"), [*tokens[1:], ""]
    ends = {"{": lambda k: True, "}": lambda k: following[k] not in (";", "else"), ";": lambda k: not open_parens[k] and following[k] != ";"}
    stops = [k + 1 for k, t in enumerate(tokens) if t in ends and ends[t](k)]
    depth = weigh("{", "}")  # a line that ends with an opening brace isn't inside it
    return "\n".join("  " * (depth[b - 1] - (tokens[b - 1] == "{")) + line_of(tokens[a:b]) for a, b in pairwise([0, *stops]))


def arrow(ddl: str):
    """Makes an Arrow function when it is first used: a type in text form needs a session to be read."""

    def wrap(f: Callable):
        return lambda *columns: F.pandas_udf(f, ddl)(*columns)

    return wrap


@arrow(LEXED)
def lexed(code: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else [{"type": t, "value": v} for t, v in lex(c)] for c in code])


@arrow("string")
def pretty(code: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else prettify(values(c)) for c in code], dtype="object")


def as_row(found: Signature, ok: bool) -> dict:
    return {
        "parsable": ok, "name": found.name, "ret_type": {"type": list(found.returns.type), "pointer_layer": found.returns.pointer_layer},
        "args": [{"type": list(a.type), "pointer_layer": a.pointer_layer, "name": a.name} for a in found.args],
    }


def signature_column(strict: bool = True):
    """An Arrow function from code to its signature; unless strict, bodies aren't lexed."""
    kind, read = to_arrow_schema(T.StructType.fromDDL(f"signature {SIGNATURE}")).field(0).type, values if strict else head

    @F.arrow_udf(SIGNATURE)
    def column(code: pa.Array) -> pa.Array:
        return row_by_row(lambda c: as_row(*parsed(read(c or ""), strict)), kind, code)

    return column


def shown_column():
    """An Arrow function from code, the text to show for it and whether to parse strictly to ``signature, code``: the code's signature and
    the text in lines (null texts have none). What is parsed and shown alike is lexed once."""
    kind = pa.struct(list(to_arrow_schema(T.StructType.fromDDL(f"signature {SIGNATURE}, code string"))))

    def row(code: str, text: str | None, strict: bool) -> dict:
        tokens = values(code)
        return {"signature": as_row(*parsed(tokens, strict)), "code": None if text is None else prettify(tokens if text == code else values(text))}

    @F.arrow_udf(f"struct<signature:{SIGNATURE},code:string>")
    def column(code: pa.Array, text: pa.Array, strict: pa.Array) -> pa.Array:
        return row_by_row(lambda c, t, s: row(c or "", t, bool(s)), kind, code, text, strict)

    return column
