"""A compiler for a small, sandboxed template language.

Text is cut into tokens, parsed to a syntax tree, folded (constant expressions, branches that are
known, neighbouring text) and turned into closures that write to an Output, which also records the
character spans written between generation markers.

    {{ expression }}   {# remark #}
    {% for name in expression %} ... {% endfor %}      loop.index0, loop.index, loop.first, loop.last
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}

Expressions: literals, names, mapping keys (a.b, a['b'], a[0]), or and not == != < <= > >= in,
+ - * % ~, a if c else b, and filters x|name. Nothing can be called, attributes of Python objects
aren't reachable, names without a value are undefined errors, and loops end with their sequence.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template can't be parsed or evaluated."""


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


# --- syntax tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """A built-in operation or filter on operands."""

    name: str
    operands: tuple


@dataclass(frozen=True)
class Choice:
    condition: object
    then: object
    otherwise: object


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    condition: object
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _in(a: object, b: object) -> bool:
    if not isinstance(b, (str, list, tuple, Mapping)):
        raise TemplateError("`in` needs a string, a sequence or a mapping")
    return a in b


def _times(a: object, b: object) -> object:
    if isinstance(a, (str, list)) or isinstance(b, (str, list)):
        raise TemplateError("only numbers are multiplied")
    return a * b


def _modulo(a: object, b: object) -> object:
    if isinstance(a, str):
        raise TemplateError("only numbers have a remainder")
    return a % b


_OPERATIONS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": _in, "not in": lambda a, b: not _in(a, b), "+": operator.add, "-": operator.sub, "*": _times, "%": _modulo,
    "~": lambda a, b: _text(a) + _text(b), "not": operator.not_, "negative": operator.neg,
}
_FILTERS: dict[str, Callable] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "string": _text}

# --- parsing ---------------------------------------------------------------------------------

_CUT = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+*%~<>=|.()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "if", "else", "is"}


class _Expression:
    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens: list[tuple[str, str]] = []
        self.filters, at = filters, 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] not in _WORDS:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def whole(self) -> object:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> object:
        value = self.either()
        if self.take("if"):
            condition = self.either()
            return Choice(condition, value, self.choice() if self.take("else") else Constant(""))
        return value

    def either(self) -> object:
        out = self.both()
        while self.take("or"):
            out = Choice(out, out, self.both())
        return out

    def both(self) -> object:
        out = self.negation()
        while self.take("and"):
            out = Choice(out, self.negation(), out)
        return out

    def negation(self) -> object:
        return Apply("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> object:
        out = self.sum()
        while (sign := self.take("==", "!=", "<", "<=", ">", ">=", "in")) or self.peek("not"):
            if not sign:
                self.need("not")
                self.need("in")
                sign = "not in"
            out = Apply(sign, (out, self.sum()))
        return out

    def sum(self) -> object:
        out = self.product()
        while sign := self.take("+", "-", "~"):
            out = Apply(sign, (out, self.product()))
        return out

    def product(self) -> object:
        out = self.unary()
        while sign := self.take("*", "%"):
            out = Apply(sign, (out, self.unary()))
        return out

    def unary(self) -> object:
        return Apply("negative", (self.unary(),)) if self.take("-") else self.filtered()

    def filtered(self) -> object:
        out = self.primary()
        while True:
            if self.take("."):
                out = Item(out, Constant(self.name()))
            elif self.take("["):
                out = Item(out, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                out = Apply(f"|{name}", (out,))
            else:
                return out

    def primary(self) -> object:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Constant(int(value))
        if kind == "string":
            self.at += 1
            return Constant(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        name = self.name()
        return Constant({"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Name(name)


def parse(source: str, filters: Mapping[str, Callable] | None = None) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    known = {**_FILTERS, **(filters or {})}
    pieces, at = [], 0
    for m in _CUT.finditer(source):
        pieces += [("text", source[at : m.start()]), ("print", m[1]) if m[1] is not None else ("tag", m[2].strip()) if m[2] is not None else ("text", "")]
        at = m.end()
    pieces.append(("text", source[at:]))
    left = iter(pieces)

    def block(*ends: str) -> tuple[tuple, str, str]:
        body: list = []
        for kind, content in left:
            if kind == "text":
                if content:
                    body.append(Text(content))
                continue
            if kind == "print":
                body.append(Print(_Expression(content, known).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(body), word, rest
            if word == "for":
                e = _Expression(rest, known)
                name = e.name()
                e.need("in")
                over = e.whole()
                body.append(For(name, over, block("endfor")[0]))
            elif word == "if":
                body.append(conditional(rest))
            elif word == "set":
                e = _Expression(rest, known)
                name = e.name()
                e.need("=")
                body.append(Set(name, e.whole()))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {content!r}")
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return tuple(body), "", ""

    def conditional(source: str) -> If:
        condition = _Expression(source, known).whole()
        then, end, rest = block("elif", "else", "endif")
        if end == "elif":
            return If(condition, then, (conditional(rest),))
        return If(condition, then, block("endif")[0] if end == "else" else ())

    return block()[0]


# --- folding ---------------------------------------------------------------------------------


def _function(name: str, filters: Mapping[str, Callable]) -> Callable:
    return filters[name[1:]] if name[0] == "|" else _OPERATIONS[name]


def _folded(e: object, filters: Mapping[str, Callable]) -> object:
    if isinstance(e, Item):
        return Item(_folded(e.of, filters), _folded(e.key, filters))
    if isinstance(e, Choice):
        condition, then, otherwise = (_folded(x, filters) for x in (e.condition, e.then, e.otherwise))
        if isinstance(condition, Constant):
            return then if condition.value else otherwise
        return Choice(condition, then, otherwise)
    if isinstance(e, Apply):
        operands = tuple(_folded(x, filters) for x in e.operands)
        if all(isinstance(x, Constant) for x in operands):
            try:
                return Constant(_function(e.name, filters)(*[x.value for x in operands]))
            except (TypeError, ZeroDivisionError, TemplateError):
                pass  # an error when rendered, and only there
        return Apply(e.name, operands)
    return e


def fold(body: tuple, filters: Mapping[str, Callable] | None = None) -> tuple:
    """The tree with constants evaluated, decided branches chosen and neighbouring text joined."""
    known = {**_FILTERS, **(filters or {})}
    out: list = []

    def add(node: object) -> None:
        if isinstance(node, Print) and isinstance(node.value, Constant):
            node = Text(_text(node.value.value))
        if isinstance(node, Text) and (not node.text or (out and isinstance(out[-1], Text))):
            if node.text:
                out[-1] = Text(out[-1].text + node.text)
            return
        out.append(node)

    for node in body:
        if isinstance(node, Print):
            add(Print(_folded(node.value, known)))
        elif isinstance(node, Set):
            add(Set(node.name, _folded(node.value, known)))
        elif isinstance(node, For):
            add(For(node.name, _folded(node.over, known), fold(node.body, known)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body, known)))
        elif isinstance(node, If):
            condition = _folded(node.condition, known)
            then, otherwise = fold(node.then, known), fold(node.otherwise, known)
            if isinstance(condition, Constant):
                for x in then if condition.value else otherwise:
                    add(x)
            else:
                add(If(condition, then, otherwise))
        else:
            add(node)
    return tuple(out)


# --- closures --------------------------------------------------------------------------------


def _evaluator(e: object, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    if isinstance(e, Constant):
        return lambda env, v=e.value: v
    if isinstance(e, Name):

        def name(env: dict, n: str = e.name) -> object:
            if n not in env:
                raise TemplateError(f"{n!r} is undefined")
            return env[n]

        return name
    if isinstance(e, Item):
        of, key = _evaluator(e.of, filters), _evaluator(e.key, filters)

        def item(env: dict) -> object:
            whole, k = of(env), key(env)
            if isinstance(whole, Mapping):
                return whole.get(k)
            if isinstance(whole, (list, tuple, str)) and isinstance(k, int) and -len(whole) <= k < len(whole):
                return whole[k]
            raise TemplateError(f"no item {k!r}")

        return item
    if isinstance(e, Choice):
        condition, then, otherwise = (_evaluator(x, filters) for x in (e.condition, e.then, e.otherwise))
        return lambda env: then(env) if condition(env) else otherwise(env)
    function, operands = _function(e.name, filters), [_evaluator(x, filters) for x in e.operands]

    def apply(env: dict) -> object:
        try:
            return function(*[x(env) for x in operands])
        except (TypeError, ZeroDivisionError) as error:
            raise TemplateError(str(error)) from error

    return apply


def _writer(body: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    steps = [_step(node, filters) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: object, filters: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    if isinstance(node, Text):
        return lambda env, out, t=node.text: out.write(t)
    if isinstance(node, Print):
        value = _evaluator(node.value, filters)
        return lambda env, out: out.write(_text(value(env)))
    if isinstance(node, Set):
        assigned = _evaluator(node.value, filters)

        def assign(env: dict, out: Output) -> None:
            env[node.name] = assigned(env)

        return assign
    if isinstance(node, If):
        condition, then, otherwise = _evaluator(node.condition, filters), _writer(node.then, filters), _writer(node.otherwise, filters)
        return lambda env, out: then(env, out) if condition(env) else otherwise(env, out)
    body = _writer(node.body, filters)
    if isinstance(node, Generation):

        def generation(env: dict, out: Output) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return generation
    over = _evaluator(node.over, filters)

    def loop(env: dict, out: Output) -> None:
        items = over(env)
        if not isinstance(items, (list, tuple)):
            raise TemplateError("a loop needs a sequence")
        own = dict(env)
        for i, x in enumerate(items):
            own[node.name] = x
            own["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i + 1 == len(items)}
            body(own, out)

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., Output]:
    """render(**values) -> Output."""
    known = {**_FILTERS, **(filters or {})}
    write = _writer(fold(parse(source, known), known), known)

    def render(**values: object) -> Output:
        out = Output()
        write(values, out)
        return out

    return render
