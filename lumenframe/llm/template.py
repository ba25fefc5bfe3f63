"""A small template language for chat formats, compiled to Python closures.

    {{ expression }}   {% if a %} {% elif b %} {% else %} {% endif %}   {% for m in messages %} {% endfor %}
    {% set name = expression %}   {% generation %} {% endgeneration %}   {# remark #}

A ``-`` inside a marker strips the white space beside it. Expressions have literals, names, ``a.b``,
``a['b']``, ``not and or == != < <= > >= in + ~ if else`` and filters ``a | name(arguments)``. Names
and members reach only values handed in, through plain dictionaries and lists; there are no calls,
Python attributes or imports. The source is parsed to a tree, constant parts are folded, and every
node becomes a closure. A template renders to a stream of (text, generated) pieces, and loops pull
their items one by one, so a conversation need not fit into memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
WORD = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>()\[\].,|]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
KEYWORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}
MISSING = object()


class TemplateError(ValueError):
    pass


class Node(NamedTuple):
    kind: str
    args: tuple


def text_of(value: Any) -> str:
    return "" if value is None or value is MISSING else "true" if value is True else "false" if value is False else str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(),
    "upper": lambda v: text_of(v).upper(),
    "lower": lambda v: text_of(v).lower(),
    "length": lambda v: len(v),
    "default": lambda v, other="": other if v is MISSING or v is None else v,
}


# -- parsing

def words(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = WORD.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        number, single, double, name, mark = m.groups()
        quoted = single if single is not None else double
        if number is not None:
            out.append(("value", int(number)))
        elif quoted is not None:
            out.append(("value", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), quoted, flags=re.S)))
        elif name in ("true", "false", "none"):
            out.append(("value", {"true": True, "false": False, "none": None}[name]))
        else:
            out.append(("mark" if mark or name in KEYWORDS else "name", mark or name))
        at = m.end()
    return out + [("end", None)]


class Expression:
    """Recursive descent over the words of one expression."""

    def __init__(self, source: str):
        self.words, self.at = words(source), 0

    def whole(self) -> Node:
        node = self.choice()
        if self.words[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return node

    def taken(self, *marks: str) -> str | None:
        kind, value = self.words[self.at]
        if kind == "mark" and value in marks:
            self.at += 1
            return value
        return None

    def need(self, mark: str) -> None:
        if not self.taken(mark):
            raise TemplateError(f"expected {mark!r}")

    def choice(self) -> Node:
        node = self.either()
        if self.taken("if"):
            test = self.either()
            node = Node("choice", (test, node, self.choice() if self.taken("else") else Node("value", ("",))))
        return node

    def either(self) -> Node:
        node = self.both()
        while self.taken("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.taken("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.taken("not") else self.compared()

    def compared(self) -> Node:
        node = self.joined()
        while op := self.taken("==", "!=", "<", "<=", ">", ">=", "in"):
            node = Node("op", (op, node, self.joined()))
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while op := self.taken("+", "~"):
            node = Node("op", (op, node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.member()
        while self.taken("|"):
            name, args = self.name(), []
            if self.taken("(") and not self.taken(")"):
                args.append(self.choice())
                while self.taken(","):
                    args.append(self.choice())
                self.need(")")
            node = Node("filter", (name, node, *args))
        return node

    def member(self) -> Node:
        node = self.atom()
        while op := self.taken(".", "["):
            if op == ".":
                node = Node("member", (node, Node("value", (self.name(),))))
            else:
                node = Node("member", (node, self.choice()))
                self.need("]")
        return node

    def name(self) -> str:
        kind, value = self.words[self.at]
        if kind != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return value

    def atom(self) -> Node:
        kind, value = self.words[self.at]
        if kind == "value":
            self.at += 1
            return Node("value", (value,))
        if self.taken("("):
            node = self.choice()
            self.need(")")
            return node
        return Node("name", (self.name(),))


def pieces(source: str) -> list[tuple[str, str]]:
    """('text' | 'out' | 'tag', content) in order."""
    out, at, strip = [], 0, False
    for m in TAG.finditer(source):
        text = source[at:m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[0][2] == "-" else text
        strip, at = m[0][-3] == "-", m.end()
        out.append(("text", text))
        if m[1] is not None:
            out.append(("out", m[1]))
        elif m[2] is not None:
            out.append(("tag", m[2].strip()))
    rest = source[at:]
    return out + [("text", rest.lstrip() if strip else rest)]


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    parts, at = pieces(source), 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal at
        body = []
        while at < len(parts):
            kind, content = parts[at]
            at += 1
            if kind == "text":
                body.append(Node("text", (content,)))
            elif kind == "out":
                body.append(Node("out", (Expression(content).whole(),)))
            else:
                head, _, rest = content.partition(" ")
                if head in ends:
                    return Node("all", tuple(body)), content
                body.append(tag(head, rest.strip()))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return Node("all", tuple(body)), ""

    def tag(head: str, rest: str) -> Node:
        if head == "if":
            test, (body, end) = Expression(rest).whole(), block("elif", "else", "endif")
            if end.startswith("elif"):
                return Node("if", (test, body, tag("if", end[4:].strip())))
            return Node("if", (test, body, block("endif")[0] if end == "else" else Node("all", ())))
        if head == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError("for needs 'name in expression'")
            return Node("for", (m[1], Expression(m[2]).whole(), block("endfor")[0]))
        if head == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError("set needs 'name = expression'")
            return Node("set", (m[1], Expression(m[2]).whole()))
        if head == "generation" and not rest:
            return Node("generation", (block("endgeneration")[0],))
        raise TemplateError(f"unknown tag {head!r}")

    return block()[0]


# -- folding

def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The tree with constant expressions computed, known branches taken and neighbouring texts joined."""
    args = tuple(fold(a, filters) if isinstance(a, Node) else a for a in node.args)
    node = Node(node.kind, args)
    if node.kind == "out" and args[0].kind == "value":
        return Node("text", (text_of(args[0].args[0]),))
    if node.kind in ("if", "choice") and args[0].kind == "value":
        return args[1] if args[0].args[0] else args[2]
    if node.kind == "all":
        flat: list[Node] = []
        for part in args:
            for piece in part.args if part.kind == "all" else (part,):
                if piece.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", (flat[-1].args[0] + piece.args[0],))
                elif piece.kind != "text" or piece.args[0]:
                    flat.append(piece)
        return Node("all", tuple(flat))
    if node.kind in ("op", "and", "or", "not", "filter", "member") and all(a.kind == "value" for a in args if isinstance(a, Node)):
        return Node("value", (value(node, filters)({}),))
    return node


# -- closures

Scope = dict[str, Any]
OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "~": lambda a, b: text_of(a) + text_of(b),
}


def member(of: Any, name: Any) -> Any:
    """Only members of plain dictionaries and lists."""
    if type(of) is dict:
        return of.get(name, MISSING)
    if type(of) is list and type(name) is int and -len(of) <= name < len(of):
        return of[name]
    return MISSING


def value(node: Node, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    """The closure that computes an expression."""
    kind, args = node
    if kind == "value":
        constant = args[0]
        return lambda scope: constant
    if kind == "name":
        name = args[0]
        return lambda scope: scope.get(name, MISSING)
    parts = [value(a, filters) for a in args if isinstance(a, Node)]
    if kind == "filter":
        if args[0] not in filters:
            raise TemplateError(f"unknown filter {args[0]!r}")
        apply = filters[args[0]]
        return lambda scope: apply(*[p(scope) for p in parts])
    if kind == "op":
        apply, (a, b) = OPERATIONS[args[0]], parts
        return lambda scope: apply(a(scope), b(scope))
    if kind == "not":
        return lambda scope: not truth(parts[0](scope))
    a, b = parts[:2]
    if kind == "and":
        return lambda scope: b(scope) if truth(a(scope)) else False
    if kind == "or":
        return lambda scope: x if truth(x := a(scope)) else b(scope)
    if kind == "member":
        return lambda scope: member(a(scope), b(scope))
    c = parts[2]
    return lambda scope: b(scope) if truth(a(scope)) else c(scope)


def truth(v: Any) -> bool:
    return v is not MISSING and bool(v)


Render = Callable[[Scope, bool], Iterator[tuple[str, bool]]]


def renderer(node: Node, filters: dict[str, Callable]) -> Render:
    """The closure that renders a part of the tree."""
    kind, args = node
    if kind == "text":
        text = args[0]

        def constant(scope: Scope, generated: bool):
            yield text, generated
        return constant
    if kind == "out":
        compute = value(args[0], filters)

        def computed(scope: Scope, generated: bool):
            yield text_of(compute(scope)), generated
        return computed
    if kind == "all":
        bodies = [renderer(a, filters) for a in args]

        def each(scope: Scope, generated: bool):
            for body in bodies:
                yield from body(scope, generated)
        return each
    if kind == "if":
        test, yes, no = value(args[0], filters), renderer(args[1], filters), renderer(args[2], filters)
        return lambda scope, generated: (yes if truth(test(scope)) else no)(scope, generated)
    if kind == "generation":
        inner = renderer(args[0], filters)
        return lambda scope, generated: inner(scope, True)
    if kind == "set":
        name, compute = args[0], value(args[1], filters)

        def assign(scope: Scope, generated: bool):
            scope[name] = compute(scope)
            yield from ()
        return assign
    name, items, body = args[0], value(args[1], filters), renderer(args[2], filters)

    def loop(scope: Scope, generated: bool):
        found = items(scope)
        stream = iter(() if found is MISSING or found is None else found)
        item, index = next(stream, MISSING), 0
        while item is not MISSING:
            after = next(stream, MISSING)
            inner = dict(scope) | {name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": after is MISSING}}
            yield from body(inner, generated)
            item, index = after, index + 1
    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the template's variables that yields (text, whether it lies in a generation block)."""
    known = FILTERS | (filters or {})
    render = renderer(fold(parse(source), known), known)
    return lambda **scope: render(dict(scope), False)
