"""A small template language for conversations, compiled to Python closures.

    {{ expression }}                      output
    {% for x in expression %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   marks text that is trained on

Expressions: strings, whole numbers, true, false, none, names, ``a.b`` and
``a['b']`` (keys of mappings and, for whole numbers, places of lists), ``+ ~ ==
!= < <= > >= in not and or``, parentheses, and filters ``| name`` out of those
given. In a loop, ``loop`` has index, index0, first and last.

The language is a sandbox: values are texts, numbers, lists and mappings; there
are no calls, no attributes of Python objects, no imports and no loops but over
lists. Constants are folded: parts that depend on no variable become text when
the template is compiled, and neighbouring texts become one.

A compiled template yields pieces ``(text, trained)`` one after another and
takes lists as iterators, so a loop over a very long conversation holds one turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any


class TemplateError(ValueError):
    """The template can't be parsed, or a value doesn't allow what is asked of it."""


_TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().\[\]|,=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"and", "or", "not", "in"}
_CONSTANTS = {"true": True, "false": False, "none": None}

Env = dict[str, Any]
Pieces = Iterator[tuple[str, bool]]
Filter = Callable[[Any], Any]


def _length(x: Any) -> int:
    if isinstance(x, (str, list, Mapping)):
        return len(x)
    raise TemplateError("length of a value that has none")


def show(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (str, int, float)):
        return str(x)
    raise TemplateError("only texts and numbers can be put out")


FILTERS: dict[str, Filter] = {
    "trim": lambda x: show(x).strip(),
    "upper": lambda x: show(x).upper(),
    "lower": lambda x: show(x).lower(),
    "length": _length,
}


class Parser:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            kind = m.lastgroup or ""
            text = m[kind]
            if kind == "str":
                text = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), text[1:-1], flags=re.S)
            self.tokens.append((kind, int(text) if kind == "int" else text))
            at = m.end()
        self.at = 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in ops

    def take(self, *ops: str) -> str | None:
        if self.peek(*ops):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise TemplateError(f"{op!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] not in _WORDS:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")

    def whole(self) -> tuple:
        out = self.either()
        self.end()
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            out = (op, out, self.joined())
        return out

    def joined(self) -> tuple:
        out = self.filtered()
        while op := self.take("+", "~"):
            out = (op, out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.value()
        while self.take("|"):
            out = ("filter", self.name(), out)
        return out

    def value(self) -> tuple:
        if self.take("("):
            out = self.either()
            self.need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] in ("str", "int"):
            out = ("const", self.tokens[self.at][1])
            self.at += 1
        else:
            name = self.name()
            out = ("const", _CONSTANTS[name]) if name in _CONSTANTS else ("name", name)
        while True:
            if self.take("."):
                out = ("get", out, ("const", self.name()))
            elif self.take("["):
                out = ("get", out, self.either())
                self.need("]")
            else:
                return out


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of nodes (kind, ...)."""
    parts = _TAGS.split(source)
    tokens: list[tuple[str, str]] = []
    for k, part in enumerate(parts):
        if k % 2 == 0:
            if k and re.match(r"\{[{%]", parts[k - 1]) and parts[k - 1][-3] == "-":
                part = part.lstrip()
            if k + 1 < len(parts) and parts[k + 1][2:3] == "-" and parts[k + 1][1] != "#":
                part = part.rstrip()
            if part:
                tokens.append(("text", part))
        elif part[1] != "#":
            tokens.append(("out" if part[1] == "{" else "tag", part[2:-2].strip("-").strip()))
    tokens.reverse()
    nodes, closed = _block(tokens, ())
    assert closed == ""
    return nodes


def _block(tokens: list[tuple[str, str]], until: tuple[str, ...]) -> tuple[list[tuple], str]:
    nodes: list[tuple] = []
    while tokens:
        kind, text = tokens.pop()
        if kind == "text":
            nodes.append(("text", text))
            continue
        if kind == "out":
            nodes.append(("out", Parser(text).whole()))
            continue
        word, _, rest = text.partition(" ")
        if word in until:
            return nodes, text
        if word == "for":
            p = Parser(rest)
            name = p.name()
            p.need("in")
            over = p.whole()
            body, _ = _block(tokens, ("endfor",))
            nodes.append(("for", name, over, body))
        elif word == "if":
            nodes.append(_branches(tokens, rest))
        elif word == "set":
            p = Parser(rest)
            name = p.name()
            p.need("=")
            nodes.append(("set", name, p.whole()))
        elif word == "generation":
            body, _ = _block(tokens, ("endgeneration",))
            nodes.append(("generation", body))
        else:
            raise TemplateError(f"unknown tag {text!r}")
    if until:
        raise TemplateError(f"{until[-1]!r} is missing")
    return nodes, ""


def _branches(tokens: list[tuple[str, str]], condition: str) -> tuple:
    body, closed = _block(tokens, ("elif", "else", "endif"))
    word, _, rest = closed.partition(" ")
    other: list[tuple] = []
    if word == "elif":
        other = [_branches(tokens, rest)]
    elif word == "else":
        other, _ = _block(tokens, ("endif",))
    return ("if", Parser(condition).whole(), body, other)


def _get(value: Any, key: Any) -> Any:
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, list) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError("only mappings and lists have parts")


def _add(x: Any, y: Any) -> Any:
    if type(x) is type(y) and isinstance(x, (str, int)):
        return x + y
    raise TemplateError("+ needs two texts or two numbers")


def _compare(op: str, x: Any, y: Any) -> bool:
    if op == "==":
        return x == y
    if op == "!=":
        return x != y
    if op == "in":
        if isinstance(y, (list, Mapping)) or isinstance(x, str) and isinstance(y, str):
            return x in y
        raise TemplateError("in needs a text, a list or a mapping")
    if type(x) is not type(y) or not isinstance(x, (str, int)):
        raise TemplateError(f"{op} needs two texts or two numbers")
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


_BINARY: dict[str, Callable[[Any, Any], Any]] = {"+": _add, "~": lambda x, y: show(x) + show(y)}


def fold(node: tuple, filters: Mapping[str, Filter]) -> tuple:
    """An expression with parts that hold no names worked out."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        inner = fold(node[2], filters)
        return ("const", filters[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    args = [fold(x, filters) for x in node[1:]]
    if kind in ("and", "or") and args[0][0] == "const":
        return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    if all(x[0] == "const" for x in args):
        return ("const", evaluate((kind, *args), filters)({}))
    return (kind, *args)


def evaluate(node: tuple, filters: Mapping[str, Filter]) -> Callable[[Env], Any]:
    """A closure that works an expression out."""
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "filter":
        apply, inner = filters[node[1]], evaluate(node[2], filters)
        return lambda env: apply(inner(env))
    args = [evaluate(x, filters) for x in node[1:]]
    if kind == "not":
        return lambda env: not args[0](env)
    if kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if kind == "or":
        return lambda env: args[0](env) or args[1](env)
    if kind == "get":
        return lambda env: _get(args[0](env), args[1](env))
    if kind in _BINARY:
        join = _BINARY[kind]
        return lambda env: join(args[0](env), args[1](env))
    return lambda env: _compare(kind, args[0](env), args[1](env))


def simplify(nodes: list[tuple], filters: Mapping[str, Filter]) -> list[tuple]:
    """The tree with constants folded, dead branches gone and texts joined."""
    out: list[tuple] = []

    def text(x: str) -> None:
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + x)
        elif x:
            out.append(("text", x))

    for node in nodes:
        kind = node[0]
        if kind == "text":
            text(node[1])
        elif kind == "out":
            e = fold(node[1], filters)
            if e[0] == "const":
                text(show(e[1]))
            else:
                out.append(("out", e))
        elif kind == "if":
            e = fold(node[1], filters)
            if e[0] == "const":
                for x in simplify(node[2] if e[1] else node[3], filters):
                    if x[0] == "text":
                        text(x[1])
                    else:
                        out.append(x)
            else:
                out.append(("if", e, simplify(node[2], filters), simplify(node[3], filters)))
        elif kind == "for":
            out.append(("for", node[1], fold(node[2], filters), simplify(node[3], filters)))
        elif kind == "set":
            out.append(("set", node[1], fold(node[2], filters)))
        else:
            out.append((kind, simplify(node[1], filters)))
    return out


def _loop(items: Any) -> Iterator[tuple[Any, dict]]:
    """Items with their place, one read ahead to know the last."""
    if isinstance(items, (str, Mapping)) or not hasattr(items, "__iter__"):
        raise TemplateError("for needs a list")
    source, index = iter(items), 0
    missing = object()
    item = next(source, missing)
    while item is not missing:
        after = next(source, missing)
        yield item, {"index": index + 1, "index0": index, "first": index == 0, "last": after is missing}
        item, index = after, index + 1


def _closure(node: tuple, filters: Mapping[str, Filter], trained: bool) -> Callable[[Env], Pieces]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], trained)
        return lambda env: iter((piece,))
    if kind == "out":
        value = evaluate(node[1], filters)
        return lambda env: iter(((show(value(env)), trained),))
    if kind == "generation":
        return _sequence(node[1], filters, True)
    if kind == "if":
        condition, yes, no = evaluate(node[1], filters), _sequence(node[2], filters, trained), _sequence(node[3], filters, trained)
        return lambda env: yes(env) if condition(env) else no(env)
    if kind == "set":
        name, value = node[1], evaluate(node[2], filters)

        def assign(env: Env) -> Pieces:
            env[name] = value(env)
            return iter(())

        return assign
    name, over, body = node[1], evaluate(node[2], filters), _sequence(node[3], filters, trained)

    def loop(env: Env) -> Pieces:
        for item, place in _loop(over(env)):
            yield from body(env | {name: item, "loop": place})

    return loop


def _sequence(nodes: list[tuple], filters: Mapping[str, Filter], trained: bool) -> Callable[[Env], Pieces]:
    parts = [_closure(x, filters, trained) for x in nodes]

    def run(env: Env) -> Pieces:
        for part in parts:
            yield from part(env)

    return run


def compiled(source: str, filters: Mapping[str, Filter] | None = None) -> Callable[[Env], Pieces]:
    """A function from variables to pieces ``(text, trained)``; empty pieces are left out."""
    known = {**FILTERS, **(filters or {})}
    run = _sequence(simplify(parse(source), known), known, False)
    return lambda env: (x for x in run(dict(env)) if x[0])
