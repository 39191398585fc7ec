"""A sandboxed chat-template language, compiled to Python closures.

``{{ expression }}``, ``{% for x in items %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set name = expression %}``, ``{% generation %}`` and ``{# comment #}``; a ``-`` inside a
tag trims white space on its side.  Expressions have literals, names, ``a.b``, ``a['b']``,
``not and or``, comparisons, ``in``, ``+ - * %``, ``~`` and filters.  Members come from
mappings and lists alone: no attribute of a Python object can be reached, nothing can be
called, and loops run over what they are given.

A template is parsed to a tree of tuples, constants are folded in it, and the tree becomes
closures that yield (text, inside generation) pieces.  A loop draws its items as it goes,
one ahead, so a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template can't be parsed, or does what the sandbox forbids."""


_TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>()\[\].,|]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}

FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "string": lambda x: _text(x),
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, a, b: str(x).replace(a, b),
}


def _text(x: Any) -> str:
    return "" if x is None else str(x)


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str, filters: Mapping[str, Callable]) -> None:
        self.tokens, at = [], 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.filters = 0, filters

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        if self.peek()[1] in values and self.peek()[0] in ("op", "name"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, not {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"a name expected, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.summed()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            left = (op, left, self.summed())
        return left

    def summed(self) -> tuple:
        left = self.multiplied()
        while op := self.take("+", "-", "~"):
            left = (op, left, self.multiplied())
        return left

    def multiplied(self) -> tuple:
        left = self.filtered()
        while op := self.take("*", "%"):
            left = (op, left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.member()
        while self.take("|"):
            name, args = self.name(), []
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
            left = ("filter", name, left, *args)
        return left

    def member(self) -> tuple:
        left = self.single()
        while op := self.take(".", "["):
            if op == ".":
                left = ("get", left, ("const", self.name()))
            else:
                left = ("get", left, self.either())
                self.need("]")
        return left

    def single(self) -> tuple:
        kind, value = self.peek()
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if kind == "num":
            self.at += 1
            return ("const", int(value))
        if kind == "str":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        if value in _WORDS and kind == "name":
            self.at += 1
            return ("const", _WORDS[value])
        return ("name", self.name())


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, list | tuple) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: b is not None and a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b if isinstance(a, int) and isinstance(b, int) else _refuse(),
    "%": lambda a, b: a % b if isinstance(a, int) and isinstance(b, int) else _refuse(),
    "~": lambda a, b: _text(a) + _text(b),
    "get": _get,
}


def _refuse() -> None:
    raise TemplateError("numbers only")


def _fold(tree: tuple, filters: Mapping[str, Callable]) -> tuple:
    """The tree with every operation on constants done."""
    op, *rest = tree
    if op in ("const", "name"):
        return tree
    head = rest[:1] if op == "filter" else []
    parts = [_fold(x, filters) for x in rest[len(head) :]]
    if all(p[0] == "const" for p in parts):
        return ("const", _closure((op, *head, *parts), filters)({}))
    if op in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (op == "and") else parts[0]
    return (op, *head, *parts)


def _closure(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    op, *rest = tree
    if op == "const":
        value = rest[0]
        return lambda env: value
    if op == "name":
        name = rest[0]
        return lambda env: env.get(name)
    if op == "filter":
        f, args = filters[rest[0]], [_closure(x, filters) for x in rest[1:]]
        if len(args) == 1:
            one = args[0]
            return lambda env: f(one(env))
        return lambda env: f(*[a(env) for a in args])
    args = [_closure(x, filters) for x in rest]
    if op == "not":
        return lambda env: not args[0](env)
    if op == "and":
        return lambda env: args[0](env) and args[1](env)
    if op == "or":
        return lambda env: args[0](env) or args[1](env)
    act, (a, b) = _BINARY[op], args
    return lambda env: act(a(env), b(env))


def _split(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "out" | "do", content), white space trimmed as asked."""
    at, trim = 0, False
    while m := _TAG.search(source, at):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if m[0].endswith("-") else text
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end = m.end()
        quote = ""
        while end < len(source) and (quote or not source.startswith(close, end)):
            c = source[end]
            if close == "#}":
                pass
            elif quote and c == "\\":
                end += 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            end += 1
        if end >= len(source):
            raise TemplateError(f"{m[0]} is not closed")
        body = source[m.end() : end]
        trim = body.endswith("-")
        body = body[:-1] if trim else body
        if close != "#}":
            yield ("out" if close == "}}" else "do"), body.strip()
        at = end + 2
    yield "text", source[at:].lstrip() if trim else source[at:]


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> list[tuple]:
    """The syntax tree: ("text", s), ("out", e), ("set", name, e), ("for", name, e, body),
    ("if", [(e, body)...]), ("generation", body), with constants folded and joined."""
    expression = lambda s: _fold(_Expression(s, filters).whole(), filters)
    stack: list[tuple[str, Any, list[tuple]]] = [("", None, [])]

    def add(node: tuple) -> None:
        body = stack[-1][2]
        if node[0] == "text" and body and body[-1][0] == "text":
            node = ("text", body.pop()[1] + node[1])
        if node != ("text", ""):
            body.append(node)

    for kind, body in _split(source):
        if kind == "text":
            add(("text", body))
        elif kind == "out":
            e = expression(body)
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        else:
            word, _, rest = body.partition(" ")
            if word == "set":
                name, eq, e = rest.partition("=")
                if not eq or not re.fullmatch(r"\s*[A-Za-z]\w*\s*", name):
                    raise TemplateError(f"cannot set {rest!r}")
                add(("set", name.strip(), expression(e)))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot loop {rest!r}")
                stack.append(("for", (m[1], expression(m[2])), []))
            elif word == "if":
                stack.append(("if", [(expression(rest), [])], []))
                stack[-1] = ("if", stack[-1][1], stack[-1][1][0][1])
            elif word in ("elif", "else") and stack[-1][0] == "if":
                arms = stack[-1][1]
                arms.append((expression(rest) if word == "elif" else ("const", True), []))
                stack[-1] = ("if", arms, arms[-1][1])
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word.startswith("end") and stack[-1][0] and word == "end" + stack[-1][0]:
                what, head, inner = stack.pop()
                if what == "for":
                    add(("for", *head, inner))
                elif what == "generation":
                    add(("generation", inner))
                else:
                    arms = [(c, b) for c, b in head if c[0] != "const" or c[1]]
                    if arms and arms[0][0][0] == "const":  # the first arm always holds
                        for node in arms[0][1]:
                            add(node)
                    elif arms:
                        add(("if", arms))
            else:
                raise TemplateError(f"unexpected tag {body!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return stack[0][2]


Renderer = Callable[[dict, bool], Iterator[Piece]]


def _loop(items: Iterable) -> Iterator[tuple[Any, dict]]:
    """Each item with its loop variables; one item is drawn ahead."""
    it, i, none = iter(items or ()), 0, object()
    now = next(it, none)
    while now is not none:
        after = next(it, none)
        yield now, {"index": i + 1, "index0": i, "first": i == 0, "last": after is none}
        now, i = after, i + 1


def _compile(body: list[tuple], filters: Mapping[str, Callable]) -> Renderer:
    parts = [_node(n, filters) for n in body]
    if len(parts) == 1:
        return parts[0]

    def run(env: dict, gen: bool) -> Iterator[Piece]:
        for p in parts:
            yield from p(env, gen)

    return run


def _node(node: tuple, filters: Mapping[str, Callable]) -> Renderer:
    kind = node[0]
    if kind == "text":
        return lambda env, gen: iter(((node[1], gen),))
    if kind == "out":
        value = _closure(node[1], filters)
        return lambda env, gen: iter(((_text(value(env)), gen),))
    if kind == "generation":
        inner = _compile(node[1], filters)
        return lambda env, gen: inner(env, True)
    if kind == "set":
        name, value = node[1], _closure(node[2], filters)

        def put(env: dict, gen: bool) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return put
    if kind == "for":
        name, items, inner = node[1], _closure(node[2], filters), _compile(node[3], filters)

        def each(env: dict, gen: bool) -> Iterator[Piece]:
            for x, loop in _loop(items(env)):
                yield from inner(env | {name: x, "loop": loop}, gen)

        return each
    arms = [(_closure(c, filters), _compile(b, filters)) for c, b in node[1]]

    def choose(env: dict, gen: bool) -> Iterator[Piece]:
        for holds, inner in arms:
            if holds(env):
                return inner(env, gen)
        return iter(())

    return choose


class Template:
    """A compiled template; ``stream`` yields pieces, ``render`` gives text and mask spans."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None) -> None:
        self.tree = parse(source, filters := {**FILTERS, **(filters or {})})
        self._run = _compile(self.tree, filters)

    def stream(self, **env: Any) -> Iterator[Piece]:
        return self._run(env, False)

    def render(self, **env: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and (start, end) of what is inside ``generation``, touching spans joined."""
        out, spans, at = [], [], 0
        for text, gen in self.stream(**env):
            if gen and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            at += len(text)
            out.append(text)
        return "".join(out), spans
