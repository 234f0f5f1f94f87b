"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}``, ``{% for m in messages %}``, ``{% if %} / {% elif %} / {% else %}`` and
``{% generation %}`` (text that the loss counts). Expressions know string, number and boolean literals, names,
``m.role`` and ``m['role']`` on mappings, ``loop.first``, ``loop.last``, ``loop.index0``, ``==``, ``!=``, ``and``, ``or``,
``not``, ``+`` and the filters of FILTERS. There are no calls, no attributes of Python objects, and no way to reach
one. Source is parsed to a tree, constants are folded, and each node becomes a closure that emits
(text, counted) segments, so a list of messages may be an iterator and is read as it is rendered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

Emit = Callable[[str, bool], None]
FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower}
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("string", "number", "name", "sign"), m.groups(), strict=True) if v is not None))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        if self.peek()[1] in wanted and self.peek()[0] in ("name", "sign"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.sum()
        while op := self.take("==", "!="):
            left = Op(op, (left, self.sum()))
        return left

    def sum(self):
        left = self.piped()
        while self.take("+"):
            left = Op("+", (left, self.piped()))
        return left

    def piped(self):
        left = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            left = Op("|" + name, (left,))
        return left

    def atom(self):
        kind, text = self.peek()
        self.at += 1
        if kind == "string":
            out = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "number":
            out = Const(int(text))
        elif kind == "name":
            out = Const({"true": True, "false": False}[text.lower()]) if text.lower() in ("true", "false") else Name(text)
        elif text == "(":
            out = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while sign := self.take(".", "["):
            kind, key = self.peek()
            self.at += 1
            if kind != ("name" if sign == "." else "string"):
                raise TemplateError("only plain keys can be read")
            key = key if sign == "." else key[1:-1]
            if key.startswith("_"):
                raise TemplateError("keys with a leading underscore are closed")
            out = Item(out, key)
            if sign == "[" and not self.take("]"):
                raise TemplateError("missing ]")
        return out


def parse(source: str) -> tuple:
    """Source to tree."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if "-" in (m[1], m[4]) else text))
        if m[2] is not None:
            pieces.append(("value", m[2]))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
        at, strip = m.end(), "-" in (m[3], m[6])
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    pieces.reverse()

    def body(*ends: str) -> tuple[tuple, str]:
        out = []
        while pieces:
            kind, text = pieces.pop()
            if kind == "text":
                out.append(Output(Const(text)))
            elif kind == "value":
                out.append(Output(_Expression(text).parse()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(out), text
                if word == "if":
                    out.append(branch(rest))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"cannot read {text!r}")
                    out.append(For(m[1], _Expression(m[2]).parse(), body("endfor")[0]))
                elif word == "generation":
                    out.append(Generation(body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[0]!r}")
        return tuple(out), ""

    def branch(test: str) -> If:
        then, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).parse(), then, (branch(end[4:]),))
        return If(_Expression(test).parse(), then, body("endif")[0] if end == "else" else ())

    return body()[0]


def fold(node):
    """The same tree with constant parts worked out and neighbouring constant text joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.value, Const):
                    y = Output(Const(_text(y.value.value)))
                    if not y.value.value:
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        out[-1] = Output(Const(out[-1].value.value + y.value.value))
                        continue
                out.append(y)
        return tuple(out)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, (For, Generation)):
        return replace(node, body=fold(node.body))
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_operate(node.op, *(a.value for a in args)))
        return Op(node.op, args)
    return node


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


def _operate(op: str, a, b=None):
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "and":
        return a and b
    if op == "or":
        return a or b
    if op == "not":
        return not a
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    return FILTERS[op[1:]](_text(a))


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        of, key = _value(node.of), node.key

        def item(env):
            x = of(env)
            return x.get(key) if isinstance(x, dict) else None

        return item
    args = [_value(a) for a in node.args]
    if len(args) == 1:
        return lambda env, op=node.op, a=args[0]: _operate(op, a(env))
    return lambda env, op=node.op, a=args[0], b=args[1]: _operate(op, a(env), b(env))


def _closure(node, counted: bool) -> Callable[[dict, Emit], None]:
    if isinstance(node, tuple):
        parts = [_closure(x, counted) for x in node]

        def block(env, emit):
            for p in parts:
                p(env, emit)

        return block
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            return lambda env, emit, t=node.value.value: emit(t, counted)
        value = _value(node.value)
        return lambda env, emit: emit(_text(value(env)), counted)
    if isinstance(node, If):
        test, then, other = _value(node.test), _closure(node.then, counted), _closure(node.other, counted)
        return lambda env, emit: (then if test(env) else other)(env, emit)
    if isinstance(node, Generation):
        return _closure(node.body, True)
    over, body, name = _value(node.over), _closure(node.body, counted), node.name

    def loop(env, emit):
        it = iter(over(env) or ())
        after, k = next(it, None), 0
        while after is not None:
            item, after = after, next(it, None)
            body({**env, name: item, "loop": {"first": k == 0, "last": after is None, "index0": k}}, emit)
            k += 1

    return loop


class Template:
    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _closure(self.tree, False)

    def render(self, messages: Iterable[dict], emit: Emit, **names) -> None:
        self._run({**names, "messages": messages}, emit)
