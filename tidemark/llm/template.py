"""A sandboxed template language: parser, constant folding, and closures that render.

Statements: for, if / elif / else, set, generation; expressions: literals, names, items by dot or
bracket, loop.index / index0 / first / last / length, filters from a fixed table, arithmetic with +
and ~, comparisons, `in`, and / or / not.  There are no calls and no attribute access: a name or an
item is looked up in mappings and lists only, so a template reaches nothing but its own data.
What stands between `{% generation %}` and `{% endgeneration %}` is reported as spans of the output;
such blocks do not nest, so no text is counted twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Control strings of the known chat formats, and stand-ins for what begins them and for the escape sign itself.
CONTROL = re.compile(r"&|<\||\|>|</?s>|\[/?INST\]|<</?SYS>>")
ENTITY = {"&": "&amp;", "<": "&lt;", "|": "&vert;", "[": "&lsqb;", "\n": "&NewLine;"}
ESCAPED = re.compile("|".join(ENTITY.values()))
PLAIN = {v: k for k, v in ENTITY.items()}


def escape(text: str) -> str:
    """No control string is left in the result; `unescape` gives the text back."""
    return CONTROL.sub(lambda m: ENTITY[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: PLAIN[m[0]], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(str(v)), "line": lambda v: escape(str(v)).replace("\n", ENTITY["\n"]), "trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(), "length": len, "string": str, "first": lambda v: v[0], "last": lambda v: v[-1],
}


class TemplateError(ValueError):
    pass


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Op:
    """An operator or filter with its operands."""

    name: str
    args: list


@dataclass
class Emit:
    value: Any


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class If:
    branches: list  # (condition, body)


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "~": lambda a, b: str(a) + str(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not": lambda a: not a,
}

_PIECE = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~|.\[\]()<>]))""")
_LITERALS = {"true": True, "false": False, "none": None}
_KEYWORDS = {"and", "or", "not", "in", "if", "else"}


def _string(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1])


class Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((("string", "number", "name", "sign")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = Op("or", [out, self.both()])
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = Op("and", [out, self.negated()])
        return out

    def negated(self):
        return Op("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self):
        out = self.added()
        while sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            out = Op(sign, [out, self.added()])
        return out

    def added(self):
        out = self.filtered()
        while sign := self.take("+", "~"):
            out = Op(sign, [out, self.filtered()])
        return out

    def filtered(self):
        out = self.item()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            out = Op(name, [out])
        return out

    def item(self):
        out = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                    raise TemplateError("a name must follow the dot")
                out = Item(out, Const(self.tokens[self.at][1]))
                self.at += 1
            else:
                out = Item(out, self.either())
                if not self.take("]"):
                    raise TemplateError("missing ]")
        return out

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(_string(token))
        if kind == "number":
            return Const(int(token))
        if kind == "name" and token in _LITERALS:
            return Const(_LITERALS[token])
        if kind == "name" and token not in _KEYWORDS:
            return Name(token)
        if token == "-" and self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
            self.at += 1
            return Const(-int(self.tokens[self.at - 1][1]))
        if token == "(":
            out = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return out
        raise TemplateError(f"unexpected {token!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    strip = False
    parts = _PIECE.split(source)
    for k, part in enumerate(parts):
        if k % 2 == 0:
            if strip:
                part = part.lstrip()
            if k + 1 < len(parts) and parts[k + 1][2:3] == "-":
                part = part.rstrip()
            if part:
                stack[-1][2].append(Emit(Const(part)))
            continue
        strip = part[-3] == "-"
        inner = part[2:-2].removeprefix("-").removesuffix("-").strip()
        if part[:2] == "{#":
            strip = False
        elif part[:2] == "{{":
            stack[-1][2].append(Emit(Expression(inner).whole()))
        else:
            _statement(inner, stack)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return stack[0][2]


def _statement(inner: str, stack: list) -> None:
    word, _, rest = inner.partition(" ")
    body: list = []
    if word == "for":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
        if not m:
            raise TemplateError(f"cannot read {inner!r}")
        node = For(m[1], Expression(m[2]).whole(), body)
        stack[-1][2].append(node)
        stack.append(("for", node, body))
    elif word == "if":
        node = If([(Expression(rest).whole(), body)])
        stack[-1][2].append(node)
        stack.append(("if", node, body))
    elif word in ("elif", "else"):
        if stack[-1][0] != "if":
            raise TemplateError(f"{word} outside if")
        node = stack.pop()[1]
        node.branches.append((Expression(rest).whole() if word == "elif" else Const(True), body))
        stack.append(("if", node, body))
    elif word == "set":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)
        if not m:
            raise TemplateError(f"cannot read {inner!r}")
        stack[-1][2].append(Set(m[1], Expression(m[2]).whole()))
    elif word == "generation":
        if any(kind == "generation" for kind, *_ in stack):
            raise TemplateError("generation within generation")
        stack[-1][2].append(Generation(body))
        stack.append(("generation", None, body))
    elif word.startswith("end") and stack[-1][0] == word[3:] and word != "end":
        stack.pop()
    else:
        raise TemplateError(f"unexpected {inner!r}")


def fold(node):
    """The same tree with constant parts worked out, dead branches gone and neighbouring texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in (fold(x) for x in node):
            if isinstance(x, If) and isinstance(x.branches[0][0], Const):
                out += x.branches[0][1] if x.branches[0][0].value else []
            elif isinstance(x, Emit) and isinstance(x.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                out[-1] = Emit(Const(out[-1].value.value + _text(x.value.value)))
            elif isinstance(x, Emit) and isinstance(x.value, Const):
                out.append(Emit(Const(_text(x.value.value))))
            elif not (isinstance(x, If) and not x.branches):
                out.append(x)
        return out
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        if all(isinstance(a, Const) for a in args):
            return Const(_apply(node.name, [a.value for a in args]))
        return Op(node.name, args)
    if isinstance(node, Item):
        of, key = fold(node.of), fold(node.key)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        branches = []
        for condition, body in node.branches:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            branches.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        return If(branches or [(Const(False), [])])
    return node


def _text(value) -> str:
    return "" if value is None else str(value)


def _apply(name: str, values: list):
    if name in ("and", "or"):
        return (values[0] and values[1]) if name == "and" else (values[0] or values[1])
    try:
        return (OPERATORS.get(name) or FILTERS[name])(*values)
    except (TypeError, IndexError) as e:
        raise TemplateError(f"{name}: {e}") from e


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node) -> Callable[[dict], Any]:
    """A closure from the variables to the value."""
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, k=node.name: env.get(k)
    if isinstance(node, Item):
        return lambda env, of=_value(node.of), key=_value(node.key): _item(of(env), key(env))
    args = [_value(a) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env, name=node.name: _apply(name, [a(env) for a in args])


def _body(nodes: list) -> Callable[[dict, Output], None]:
    steps = [_step(x) for x in nodes]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            return lambda env, out, text=_text(node.value.value): out.add(text)
        return lambda env, out, value=_value(node.value): out.add(_text(value(env)))
    if isinstance(node, Set):
        value = _value(node.value)
        return lambda env, out: env.__setitem__(node.name, value(env))
    if isinstance(node, Generation):
        body = _body(node.body)

        def marked(env, out):
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return marked
    if isinstance(node, If):
        branches = [(_value(c), _body(b)) for c, b in node.branches]

        def choose(env, out):
            for condition, body in branches:
                if condition(env):
                    return body(env, out)

        return choose
    over, body = _value(node.over), _body(node.body)

    def loop(env, out):
        rows = over(env) or []
        if not isinstance(rows, (list, tuple)):
            raise TemplateError("for needs a list")
        held = {k: env.get(k) for k in (node.name, "loop")}
        for k, row in enumerate(rows):
            env[node.name] = row
            env["loop"] = {"index": k + 1, "index0": k, "first": not k, "last": k == len(rows) - 1, "length": len(rows)}
            body(env, out)
        env.update(held)

    return loop


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """source -> a function of variables that gives the text and the spans under generation markers."""
    body = _body(fold(parse(source)))

    def render(**variables) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        body(dict(variables), out)
        return "".join(out.parts), out.spans

    return render
