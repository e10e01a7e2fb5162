"""A sandboxed chat template language: parsed into a syntax tree, folded, and turned into Python closures.

Text stands for itself.  ``{{ expression }}`` puts a value out, ``{# #}`` is a comment, and a ``-`` inside the marks of a tag
takes the white space beside it away.  ``{% for x in list %}`` (with ``loop.index``, ``index0``, ``first``, ``last``, and
``if``), ``{% if %}``, ``{% elif %}``, ``{% else %}``, ``{% set x = y %}`` and ``{% generation %}`` control what is put out;
what is put out between generation marks is flagged.  Expressions have strings, integers, lists, true, false, none, names,
fields (``m.role``, ``m['role']``), items and slices (``list[0]``, ``list[1:]``), ``a if b else c``, ``or``, ``and``, ``not``,
comparisons, ``in``, tests (``x is defined``, ``is not none``, ...), ``~`` (join as text), ``+ - * // %`` and filters with
arguments (``x|default('')``).  ``raise_exception(text)`` stops the rendering.

The sandbox is the language itself: there are no other calls and no Python attributes, fields are looked up in
dictionaries only, and filters are those that the caller hands over.  A field that is not there is undefined: it may be
tested, or given a default, but to put it out or to look into it is an error.  Loops take iterators as they come, so a
conversation of any length is rendered as it streams by, unless an item is asked for by its number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator


class TemplateError(ValueError):
    """The template is not in the language, or a rendering asks for what is not there."""


class _Undefined:
    def __bool__(self) -> bool:
        return False


UNDEFINED = _Undefined()


def _text(value: object) -> str:
    if value is UNDEFINED:
        raise TemplateError("an undefined value is put out")
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable[..., object]] = {
    "default": lambda v, d="": d if v is UNDEFINED else v,
    "first": lambda v: next(iter(v), UNDEFINED),
    "join": lambda v, by="": by.join(map(_text, v)),
    "last": lambda v: v[-1] if v else UNDEFINED,
    "length": lambda v: len(v),
    "lower": lambda v: _text(v).lower(),
    "replace": lambda v, a, b: _text(v).replace(a, b),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
}
TESTS: dict[str, Callable[[object], bool]] = {
    "defined": lambda v: v is not UNDEFINED,
    "undefined": lambda v: v is UNDEFINED,
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "mapping": lambda v: isinstance(v, dict),
    "odd": lambda v: v % 2 == 1,
    "even": lambda v: v % 2 == 0,
}
_STRING = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
#: A tag ends at the first closing mark outside a string.
_TAG = re.compile(rf"""(?s)(\{{\{{-?(?:{_STRING}|[^"'])*?\}}\}}|\{{%-?(?:{_STRING}|[^"'])*?%\}}|\{{#.*?#\}})""")
_TOKEN = re.compile(rf"\s*(?:({_STRING})|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~|.,:<>=\[\]()]))")
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
#: Binary operators by how tightly they bind, loosest first.
_LEVELS = [("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in", "is"), ("~",), ("+", "-"), ("*", "//", "%")]


class _Expression:
    """Recursive descent over one expression; nodes are tuples that begin with their kind."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, object]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable expression: {source[at:]!r}")
            if m[1]:
                self.tokens.append(("const", re.sub(r"(?s)\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1])))
            elif m[2]:
                self.tokens.append(("const", int(m[2])))
            else:
                self.tokens.append(("name", m[3]) if m[3] else ("mark", m[4]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> object:
        kind, value = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", None)
        return value if kind in ("mark", "name") else None

    def next(self) -> tuple[str, object]:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, mark: str) -> bool:
        if self.peek() == mark:
            self.at += 1
            return True
        return False

    def must(self, mark: str) -> None:
        if not self.take(mark):
            raise TemplateError(f"missing {mark}")

    def name(self) -> str:
        kind, value = self.next()
        if kind != "name":
            raise TemplateError(f"a name is needed instead of {value!r}")
        return value

    def whole(self):
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self):
        node = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            node = ("choice", test, node, self.choice() if self.take("else") else ("const", UNDEFINED))
        return node

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.filtered()
        if _LEVELS[level] == ("not",):
            return ("not", self.binary(level)) if self.take("not") else self.binary(level + 1)
        node = self.binary(level + 1)
        while self.peek() in _LEVELS[level] or (level == 3 and self.peek() == "not" and self.peek(1) == "in"):
            op = self.next()[1]
            if op == "is":
                negated, kind = self.take("not"), self.name()
                if kind not in TESTS:
                    raise TemplateError(f"unknown test: {kind}")
                node = ("test", kind, node)
                node = ("not", node) if negated else node
            elif op == "not":
                self.next()
                node = ("not", ("in", node, self.binary(level + 1)))
            else:
                node = (op, node, self.binary(level + 1))
        return node

    def arguments(self) -> list:
        out = []
        if self.take("("):
            while not self.take(")"):
                out.append(self.choice())
                if self.peek() != ")":
                    self.must(",")
        return out

    def filtered(self):
        node = self.field()
        while self.take("|"):
            node = ("filter", self.name(), node, *self.arguments())
        return node

    def field(self):
        if self.take("-"):
            return ("-", ("const", 0), self.field())
        kind, value = self.next()
        if kind == "const":
            node = ("const", value)
        elif kind == "name":
            if value == "raise_exception" and self.peek() == "(":
                node = ("raise", *(self.arguments() or [("const", "")])[:1])
            else:
                node = ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        elif value == "(":
            node = self.choice()
            self.must(")")
        elif value == "[":
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if self.peek() != "]":
                    self.must(",")
            node = ("list", *items)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek() in (".", "["):
            if self.next()[1] == ".":
                node = ("field", node, ("const", self.name()))
                continue
            ends = [("const", None), ("const", None)]
            if self.peek() != ":":
                ends[0] = self.choice()
            if self.take(":"):
                if self.peek() != "]":
                    ends[1] = self.choice()
                node = ("slice", node, *ends)
            else:
                node = ("field", node, ends[0])
            self.must("]")
        if self.peek() == "(":
            raise TemplateError("there are no calls")
        return node


def _pieces(source: str) -> list[str]:
    """Text and tags by turns, white space taken away beside a ``-``; comments are gone."""
    parts = _TAG.split(source)
    for k in range(1, len(parts), 2):
        if parts[k][2:3] == "-":
            parts[k - 1], parts[k] = parts[k - 1].rstrip(), parts[k][:2] + parts[k][3:]
        if parts[k][-3:-2] == "-":
            parts[k + 1], parts[k] = parts[k + 1].lstrip(), parts[k][:-3] + parts[k][-2:]
    for text in parts[::2]:
        if (m := re.search(r"\{[{%#]", text)) is not None:
            raise TemplateError(f"unclosed tag: {text[m.start() : m.start() + 20]!r}")
    return [p for p in parts if p and not p.startswith("{#")]


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: a list of text, put, for, if, set and generation nodes."""
    parts, at = _pieces(source), 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("put", _Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                tag = part[2:-2].strip()
                word, _, rest = tag.partition(" ")
                if word in ends:
                    return nodes, tag
                if word == "for":
                    m = re.fullmatch(r"(?s)([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip())
                    if not m:
                        raise TemplateError(f"unreadable loop: {tag}")
                    e = _Expression(m[2])
                    items = e.binary(0)
                    test = e.whole() if e.take("if") else ("const", True)
                    if e.at < len(e.tokens):
                        raise TemplateError(f"unreadable loop: {tag}")
                    nodes.append(("for", m[1], items, test, block(("endfor",))[0]))
                elif word == "set":
                    m = re.fullmatch(r"(?s)([A-Za-z_]\w*)\s*=\s*(.*)", rest.strip())
                    if not m:
                        raise TemplateError(f"unreadable set: {tag}")
                    nodes.append(("set", m[1], _Expression(m[2]).whole()))
                elif word == "generation":
                    nodes.append(("generation", block(("endgeneration",))[0]))
                elif word == "if":
                    arms, end = [], tag
                    while not end.startswith("endif"):
                        word, _, rest = end.partition(" ")
                        test = ("const", True) if word == "else" else _Expression(rest).whole()
                        body, end = block(("endif",) if word == "else" else ("elif", "else", "endif"))
                        arms.append((test, body))
                    nodes.append(("if", arms))
                else:
                    raise TemplateError(f"unknown tag: {tag}")
            else:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    return block(())[0]


def _look_up(owner: object, key: object) -> object:
    """A field of a dictionary or an item of a list; nothing else has any."""
    if owner is UNDEFINED or owner is None:
        raise TemplateError(f"{key!r} of an undefined value")
    if isinstance(owner, dict):
        return owner.get(key, UNDEFINED)
    if isinstance(owner, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return owner[key] if -len(owner) <= key < len(owner) else UNDEFINED
    raise TemplateError(f"no field {key!r}")


_OPERATIONS: dict[str, Callable[..., object]] = {
    "not": lambda a: not a,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b,
    "list": lambda *a: list(a),
    "field": _look_up,
    "slice": lambda v, a, b: v[a:b],
}


def _operation(node: tuple, filters: dict) -> Callable[..., object]:
    """What a node does with the values of its parts; whatever goes wrong is an error of the template."""
    kind = node[0]
    f = filters[node[1]] if kind == "filter" else TESTS[node[1]] if kind == "test" else _OPERATIONS[kind]

    def run(*values: object) -> object:
        try:
            return f(*values)
        except (TypeError, ZeroDivisionError, AttributeError) as e:
            raise TemplateError(f"{node[1] if kind in ('filter', 'test') else kind}: {e}") from e

    return run


def _parts(node: tuple) -> tuple:
    return node[2:] if node[0] in ("filter", "test") else node[1:]


def fold(node: tuple, filters: dict) -> tuple:
    """The expression with every part that no name reaches replaced by its value."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter" and node[1] not in filters:
        raise TemplateError(f"unknown filter: {node[1]}")
    inner = [fold(x, filters) for x in _parts(node)]
    if kind in ("and", "or"):
        if inner[0][0] == "const":
            return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    elif kind == "choice":
        if inner[0][0] == "const":
            return inner[1] if inner[0][1] else inner[2]
    elif kind not in ("raise", "list") and all(x[0] == "const" for x in inner):
        return ("const", _operation(node, filters)(*[x[1] for x in inner]))
    return (kind, node[1], *inner) if kind in ("filter", "test") else (kind, *inner)


def fold_block(nodes: list[tuple], filters: dict) -> list[tuple]:
    """The block with constant output merged into text and dead arms of conditions removed."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node[0] != "text" or node[1]:
            out.append(node)

    for node in nodes:
        if node[0] == "put":
            e = fold(node[1], filters)
            add(("text", _text(e[1])) if e[0] == "const" else ("put", e))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2], filters), fold(node[3], filters), fold_block(node[4], filters)))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2], filters)))
        elif node[0] == "generation":
            add(("generation", fold_block(node[1], filters)))
        elif node[0] == "if":
            arms = []
            for test, body in node[1]:
                test = fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_block(body, filters)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        else:
            add(node)
    return out


def _value(node: tuple, filters: dict) -> Callable[[dict], object]:
    """A closure that gives the value of an expression in a scope."""
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n, UNDEFINED)
    inner = [_value(x, filters) for x in _parts(node)]
    if kind == "and":
        return lambda scope, a=inner[0], b=inner[1]: a(scope) and b(scope)
    if kind == "or":
        return lambda scope, a=inner[0], b=inner[1]: a(scope) or b(scope)
    if kind == "choice":
        return lambda scope: inner[1](scope) if inner[0](scope) else inner[2](scope)
    if kind == "raise":
        def fail(scope):
            raise TemplateError(_text(inner[0](scope)))
        return fail
    f = _operation(node, filters)
    if len(inner) == 1:
        return lambda scope, x=inner[0]: f(x(scope))
    return lambda scope: f(*[x(scope) for x in inner])


def _loop(items: Iterator, test: Callable, name: str, scope: dict) -> Iterator[dict]:
    """Scopes of a loop's rounds, one item read ahead to know the last."""
    wanted = (inner for item in items if test(inner := scope | {name: item}))
    now, index = next(wanted, None), 0
    while now is not None:
        after = next(wanted, None)
        now["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": after is None}
        yield now
        now, index = after, index + 1


def _closure(nodes: list[tuple], filters: dict, flagged: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A generator function that puts out (text, flagged) pieces of a block in a scope, which ``set`` changes."""
    steps = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda scope, piece=(node[1], flagged): (piece,))
        elif node[0] == "put":
            steps.append(lambda scope, f=_value(node[1], filters): ((_text(f(scope)), flagged),))
        elif node[0] == "generation":
            steps.append(_closure(node[1], filters, True))
        elif node[0] == "set":
            def assign(scope, name=node[1], f=_value(node[2], filters)):
                scope[name] = f(scope)
                return ()
            steps.append(assign)
        elif node[0] == "for":
            def loop(scope, name=node[1], items=_value(node[2], filters), test=_value(node[3], filters), body=_closure(node[4], filters, flagged)):
                found = items(scope)
                if found is UNDEFINED or found is None or isinstance(found, (int, str)):
                    raise TemplateError("a loop needs a list")
                for inner in _loop(iter(found), test, name, scope):
                    yield from body(inner)
            steps.append(loop)
        else:
            def choice(scope, arms=[(_value(t, filters), _closure(b, filters, flagged)) for t, b in node[1]]):
                for test, body in arms:
                    if test(scope):
                        return body(scope)
                return ()
            steps.append(choice)

    def run(scope: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope)

    return run


def compile_template(source: str, filters: dict | None = None) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """Render function of a template: scope -> pieces of (text, whether under a generation mark)."""
    known = FILTERS | (filters or {})
    run = _closure(fold_block(parse(source), known), known, False)
    return lambda scope: run(dict(scope))
