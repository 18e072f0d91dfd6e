"""A small sandboxed template language for conversations, compiled to Python closures.

    {{ expression }}                      output
    {% for x in expression %} … {% endfor %}
    {% if expression %} … {% elif expression %} … {% else %} … {% endif %}
    {% generation %} … {% endgeneration %}  marks text that the model is to learn

Expressions have strings, whole numbers, true, false, none, names, members of mappings (a.b), ==, !=,
and, or, not, + and the filters given to the compiler. Nothing else can be reached: a member is looked
up in a mapping and never on a Python object. In a loop, loop.index, loop.first and loop.last are known.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, NamedTuple

Piece = tuple[str, bool]  # text, whether it is generated
Render = Callable[[dict, bool], Iterator[Piece]]


class TemplateError(ValueError):
    pass


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Member(NamedTuple):
    of: Any
    name: str


class Apply(NamedTuple):
    operator: str
    parts: tuple


class Text(NamedTuple):
    text: str


class Output(NamedTuple):
    value: Any


class Loop(NamedTuple):
    name: str
    items: Any
    body: tuple


class Choice(NamedTuple):
    branches: tuple  # (condition, body)


class Generation(NamedTuple):
    body: tuple


MARK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([0-9]+)|([A-Za-z_][A-Za-z_0-9]*)|(==|!=|[+|.()]))""")
WORDS = {"true": True, "false": False, "none": None}
OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a,
}
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEVELS = (("or",), ("and",), ("==", "!="), ("+",))


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at, self.filters = 0, filters

    def peek(self) -> str | None:
        """The next name or sign."""
        if self.at == len(self.tokens):
            return None
        return self.tokens[self.at][2] or self.tokens[self.at][3]

    def take(self, *wanted: str) -> str | None:
        if (found := self.peek()) is not None and found in wanted:
            self.at += 1
            return found
        return None

    def parse(self) -> Any:
        value = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError("something follows the expression")
        return value

    def level(self, depth: int) -> Any:
        if depth == len(LEVELS):
            return self.negation()
        value = self.level(depth + 1)
        while operator := self.take(*LEVELS[depth]):
            value = Apply(operator, (value, self.level(depth + 1)))
        return value

    def negation(self) -> Any:
        if self.take("not"):
            return Apply("not", (self.negation(),))
        value = self.atom()
        while sign := self.take(".", "|"):
            name = self.peek()
            if name is None or not name.isidentifier():
                raise TemplateError(f"a name must follow {sign}")
            self.at += 1
            if sign == "|" and name not in self.filters:
                raise TemplateError(f"unknown filter {name}")
            value = Member(value, name) if sign == "." else Apply(f"|{name}", (value,))
        return value

    def atom(self) -> Any:
        if self.take("("):
            value = self.level(0)
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return value
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        text, number, name, sign = self.tokens[self.at]
        self.at += 1
        if text is not None:
            return Const(ESCAPED.sub(lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if number is not None:
            return Const(int(number))
        if name is not None:
            return Const(WORDS[name]) if name in WORDS else Name(name)
        raise TemplateError(f"unexpected {sign}")


def parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    """The syntax tree: a tuple of nodes."""
    parts, at = [], 0
    for m in MARK.finditer(source):
        parts += [("text", source[at : m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    parts.append(("text", source[at:]))
    parts.reverse()

    def body(*ends: str) -> tuple[tuple, str]:
        nodes: list = []
        while parts:
            kind, value = parts.pop()
            word, _, rest = value.partition(" ")
            if kind == "text":
                nodes += [Text(value)] if value else []
            elif kind == "out":
                nodes.append(Output(_Expression(value, filters).parse()))
            elif word in ends:
                return tuple(nodes), value
            elif word == "for":
                name, _, items = rest.partition(" in ")
                nodes.append(Loop(name.strip(), _Expression(items, filters).parse(), body("endfor")[0]))
            elif word == "generation":
                nodes.append(Generation(body("endgeneration")[0]))
            elif word == "if":
                branches, condition = [], _Expression(rest, filters).parse()
                while True:
                    inner, end = body("elif", "else", "endif")
                    branches.append((condition, inner))
                    if end == "endif":
                        break
                    condition = Const(True) if end == "else" else _Expression(end.partition(" ")[2], filters).parse()
                nodes.append(Choice(tuple(branches)))
            else:
                raise TemplateError(f"unexpected {{% {value} %}}")
        if ends:
            raise TemplateError(f"{{% {ends[-1]} %}} is missing")
        return tuple(nodes), ""

    return body()[0]


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with constant parts worked out: expressions, outputs, and branches never or always taken."""
    if isinstance(node, Apply):
        parts = tuple(fold(p, filters) for p in node.parts)
        if all(isinstance(p, Const) for p in parts):
            call = filters[node.operator[1:]] if node.operator[0] == "|" else OPERATORS[node.operator]
            return Const(call(*(p.value for p in parts)))
        return Apply(node.operator, parts)
    if isinstance(node, Member):
        return Member(fold(node.of, filters), node.name)
    if isinstance(node, Output):
        value = fold(node.value, filters)
        return Text(written(value.value)) if isinstance(value, Const) else Output(value)
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.items, filters), fold_all(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold_all(node.body, filters))
    if isinstance(node, Choice):
        branches = []
        for condition, inner in node.branches:
            condition = fold(condition, filters)
            if not isinstance(condition, Const) or condition.value:
                branches.append((condition, fold_all(inner, filters)))
            if isinstance(condition, Const) and condition.value:
                break
        return Choice(tuple(branches))
    return node


def fold_all(nodes: tuple, filters: Mapping[str, Callable]) -> tuple:
    """Folded nodes: sure choices become their branch, neighbouring texts one."""
    out: list = []
    for node in (fold(n, filters) for n in nodes):
        sure = isinstance(node, Choice) and (not node.branches or isinstance(node.branches[0][0], Const))
        for part in (node.branches[0][1] if node.branches else ()) if sure else (node,):
            if isinstance(part, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + part.text)
            elif not isinstance(part, Text) or part.text:
                out.append(part)
    return tuple(out)


def written(value: Any) -> str:
    return "" if value is None else str(value)


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A closure that works an expression out."""
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):
        return lambda scope: scope.get(node.name)
    if isinstance(node, Member):
        of = _value(node.of, filters)

        def member(scope: dict) -> Any:
            holder = of(scope)
            return holder.get(node.name) if isinstance(holder, Mapping) else None

        return member
    parts = [_value(p, filters) for p in node.parts]
    if node.operator == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if node.operator == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    call = filters[node.operator[1:]] if node.operator[0] == "|" else OPERATORS[node.operator]
    return lambda scope: call(*(p(scope) for p in parts))


def _render(nodes: tuple, filters: Mapping[str, Callable]) -> Render:
    """A closure that writes nodes piece by piece."""
    steps = [_step(n, filters) for n in nodes]

    def render(scope: dict, generated: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, generated)

    return render


def _step(node: Any, filters: Mapping[str, Callable]) -> Render:
    if isinstance(node, Text):
        return lambda scope, generated: iter(((node.text, generated),))
    if isinstance(node, Output):
        value = _value(node.value, filters)
        return lambda scope, generated: iter(((written(value(scope)), generated),))
    if isinstance(node, Generation):
        inner = _render(node.body, filters)
        return lambda scope, generated: inner(scope, True)
    if isinstance(node, Loop):
        return _loop(node, filters)
    branches = [(_value(c, filters), _render(b, filters)) for c, b in node.branches]

    def choose(scope: dict, generated: bool) -> Iterator[Piece]:
        for condition, inner in branches:
            if condition(scope):
                return inner(scope, generated)
        return iter(())

    return choose


def _loop(node: Loop, filters: Mapping[str, Callable]) -> Render:
    items, inner = _value(node.items, filters), _render(node.body, filters)
    end = object()

    def loop(scope: dict, generated: bool) -> Iterator[Piece]:
        source = iter(items(scope) or ())
        index, item = 1, next(source, end)
        while item is not end:  # one item is read ahead, never the whole list
            following = next(source, end)
            place = {"index": index, "first": index == 1, "last": following is end}
            yield from inner({**scope, node.name: item, "loop": place}, generated)
            index, item = index + 1, following

    return loop


def compiled(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Iterable[Mapping]], Iterator[Piece]]:
    """messages -> pieces (text, generated); messages may be any iterable and are read one by one."""
    filters = filters or {}
    render = _render(fold_all(parse(source, filters), filters), filters)
    return lambda messages: render({"messages": messages}, False)
