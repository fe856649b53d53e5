"""Chat formatting: a compiler from a small sandboxed template language to Python closures."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col

CHAT = (
    "{% for message in messages %}{{ '<|im_start|>' + message.role + '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content + '<|im_end|>' }}{% endgeneration %}"
    "{% else %}{{ message.content + '<|im_end|>' }}{% endif %}{{ '\\n' }}{% endfor %}"
)

_TOKEN = re.compile(r"""\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*/%~<>()\[\].,|:={}]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
MISSING = object()
#: Elements that range() makes at most.
LONGEST = 100_000


class TemplateError(ValueError):
    """A template that cannot be parsed, or a value it cannot work on."""


# --- Syntax tree: tuples (kind, ...). Expressions are pure; statements write.


class _Expr:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            number, string, name, sign = m.groups()
            if number and len(number) > 300:
                raise TemplateError("a number is too long")
            if number:
                self.tokens.append(("lit", float(number) if "." in number else int(number)))
            elif string:
                self.tokens.append(("lit", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "lit" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        out = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> tuple:
        out = self.either()
        if self.take("if"):
            test = self.either()
            return ("cond", test, out, self.choice() if self.take("else") else ("lit", ""))
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
        out = self.added()
        while True:
            if sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
                out = ("op", sign, out, self.added())
            elif self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("name", "in"):
                self.at += 2
                out = ("not", ("op", "in", out, self.added()))
            elif self.take("is"):
                wrong = self.take("not")
                test = self.word()
                more = self.arguments()[0] if self.take("(") else [self.reached()] if test in _TESTS_OF_TWO else []
                out = ("is", test, out, more)
                out = ("not", out) if wrong else out
            else:
                return out

    def added(self) -> tuple:
        out = self.multiplied()
        while sign := self.take("+", "-", "~"):
            out = ("op", sign, out, self.multiplied())
        return out

    def multiplied(self) -> tuple:
        out = self.filtered()
        while sign := self.take("*", "/", "//", "%"):
            out = ("op", sign, out, self.filtered())
        return out

    def filtered(self) -> tuple:
        if self.take("-"):
            return ("op", "-", ("lit", 0), self.filtered())
        out = self.reached()
        while self.take("|"):
            out = ("filter", self.word(), out, *(self.arguments() if self.take("(") else ([], [])))
        return out

    def items(self, end: str) -> list[tuple]:
        out = []
        while not self.take(end):
            out.append(self.choice())
            if not self.peek(end):
                self.need(",")
        return out

    def arguments(self) -> tuple[list[tuple], list[tuple]]:
        """Arguments by place, and those by name as (name, expression)."""
        plain, named = [], []
        while not self.take(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("sign", "="):
                name = self.word()
                self.need("=")
                named.append(("pair", name, self.choice()))
            elif named:
                raise TemplateError("an argument without a name after one with a name")
            else:
                plain.append(self.choice())
            if not self.peek(")"):
                self.need(",")
        return plain, named

    def reached(self) -> tuple:
        out = self.atom()
        while True:
            if self.take("."):
                out = ("get", out, ("lit", self.word()))
            elif self.take("["):
                bounds: list = [None if self.peek(":", "]") else self.choice()]
                while len(bounds) < 3 and self.take(":"):
                    bounds.append(None if self.peek(":", "]") else self.choice())
                if bounds == [None]:
                    raise TemplateError("a place expected")
                out = ("get", out, bounds[0]) if len(bounds) == 1 else ("slice", out, *bounds, *[None] * (3 - len(bounds)))
                self.need("]")
            elif out[0] == "name" and self.take("("):
                out = ("call", out[1], *self.arguments())
            elif out[0] == "get" and out[2][0] == "lit" and isinstance(out[2][1], str) and self.take("("):
                out = ("method", out[2][1], out[1], *self.arguments())
            else:
                return out

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "lit":
            return (kind, value)
        if kind == "name":
            words = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            if value in words:
                return ("lit", words[value])
            if value in ("and", "or", "not", "if", "else", "in", "is"):
                raise TemplateError(f"unexpected {value!r}")
            return (kind, value)
        if value == "(":
            out = self.choice()
            if self.peek(","):
                self.at += 1
                return ("list", [out, *self.items(")")])
            self.need(")")
            return out
        if value == "[":
            return ("list", self.items("]"))
        if value == "{":
            pairs = []
            while not self.take("}"):
                key = self.choice()
                self.need(":")
                pairs += [key, self.choice()]
                if not self.peek("}"):
                    self.need(",")
            return ("dict", pairs)
        raise TemplateError(f"unexpected {value!r}")


_LOOP = re.compile(r"\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+in\s+(.*)", re.S)


def _loop(rest: str) -> list:
    """Names, values and condition of a for statement."""
    m = _LOOP.fullmatch(rest)
    if not m:
        raise TemplateError(f"for {rest}")
    p = _Expr(m[2])
    values = p.either()
    test = p.choice() if p.take("if") else ("lit", True)
    if p.at != len(p.tokens):
        raise TemplateError(f"unexpected {p.tokens[p.at][1]!r}")
    return [tuple(x.strip() for x in m[1].split(",")), values, test]


def parse(source: str) -> list[tuple]:
    """The template's statements: text, put, for, if, set, generation."""
    parts = re.split(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", source, flags=re.S)
    for i in range(1, len(parts), 2):
        if parts[i].startswith(("{{-", "{%-")):
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i].endswith(("-}}", "-%}")):
            parts[i + 1] = parts[i + 1].lstrip()
    stack: list[tuple[str, list]] = [("", [])]
    for i, part in enumerate(parts):
        body = stack[-1][1]
        if i % 2 == 0:
            if part:
                body.append(("text", part))
            continue
        if part.startswith("{#"):
            continue
        inner = part[3 if part[2] == "-" else 2 : -3 if part[-3] == "-" else -2].strip()
        if part.startswith("{{"):
            body.append(("put", _Expr(inner).whole()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "for":
            stack += [("for", _loop(rest)), ("body", [])]
        elif word == "if":
            stack += [("if", [_Expr(rest).whole()]), ("body", [])]
        elif word in ("elif", "else") and len(stack) > 2 and stack[-2][0] == "if":
            stack[-2][1].append(stack.pop()[1])
            stack[-1][1].append(_Expr(rest).whole() if word == "elif" else ("lit", True))
            stack.append(("body", []))
        elif word == "else" and len(stack) > 2 and stack[-2][0] == "for" and len(stack[-2][1]) == 3:
            stack[-2][1].append(stack.pop()[1])
            stack.append(("body", []))
        elif word in ("endif", "endfor") and len(stack) > 2 and stack[-2][0] == word[3:]:
            last = stack.pop()[1]
            kind, held = stack.pop()
            if kind == "for" and len(held) == 3:
                held, last = [*held, last], []
            stack[-1][1].append((kind, *held, last))
        elif word == "generation":
            stack.append(("generation", []))
        elif word == "endgeneration" and stack[-1][0] == "generation":
            inside = stack.pop()[1]
            stack[-1][1].append(("generation", inside))
        elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)(?:\.([A-Za-z_]\w*))?\s*=(.*)", rest, re.S)):
            body.append(("set", (m[1], m[2]), _Expr(m[3]).whole()))
        else:
            raise TemplateError(f"unexpected {{% {inner} %}}")
    if len(stack) != 1:
        raise TemplateError(f"{stack[-2][0] or stack[-1][0]} is not ended")
    return stack[0][1]


# --- What expressions may do. Values are only str, int, float, bool, None, list and dict.


class Namespace(dict):
    """What namespace() makes: the only value whose entries may be set."""


def _text(v: Any) -> str:
    return "" if v is MISSING else "None" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else str(v)


def _get(v: Any, key: Any) -> Any:
    if isinstance(v, dict):
        return v.get(key, MISSING)
    if isinstance(v, (list, str)) and isinstance(key, int):
        return v[key] if -len(v) <= key < len(v) else MISSING
    return MISSING


def _op(sign: str, a: Any, b: Any) -> Any:
    if a is MISSING or b is MISSING:
        if sign in ("==", "!="):
            return (a is b) == (sign == "==")
        if sign != "~":
            raise TemplateError(f"a missing value at {sign}")
    try:
        match sign:
            case "+": return a + b
            case "-": return a - b
            case "~": return _text(a) + _text(b)
            case "*":
                if not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
                    raise TypeError("only numbers are multiplied")
                return a * b
            case "/": return a / b
            case "//": return a // b
            case "%":
                if isinstance(a, str):
                    raise TypeError("no formatting")
                return a % b
            case "==": return a == b
            case "!=": return a != b
            case "<": return a < b
            case ">": return a > b
            case "<=": return a <= b
            case ">=": return a >= b
            case _: return a in b
    except (TypeError, ZeroDivisionError, OverflowError) as e:
        raise TemplateError(f"{sign}: {e}") from e


def _strip(v: str, chars: Any = None) -> str:
    return v.strip(None if chars is None else _text(chars))


def _json(v: Any, indent: Any = None, ensure_ascii: Any = False, sort_keys: Any = False) -> str:
    return json.dumps(None if v is MISSING else v, indent=indent, ensure_ascii=bool(ensure_ascii), sort_keys=bool(sort_keys))


def _path(v: Any, name: Any) -> Any:
    for part in _text(name).split("."):
        v = _get(v, int(part) if part.isdigit() else part)
    return v


def _map(v: Any, name: Any = MISSING, *more: Any, attribute: Any = MISSING, default: Any = MISSING) -> list:
    if attribute is not MISSING:
        found = [_path(x, attribute) for x in _list(v)]
        return [default if x is MISSING else x for x in found]
    if name not in _FILTERS:
        raise TemplateError(f"no such filter: {name}")
    return [_FILTERS[name](x, *more) for x in _list(v)]


def _select(wanted: bool, by_name: bool) -> Callable:
    def run(v: Any, *args: Any) -> list:
        name, args = (args[0], args[1:]) if by_name else (None, args)
        test = args[0] if args else "truth"
        if test not in _TESTS:
            raise TemplateError(f"no such test: {test}")
        return [x for x in _list(v) if _TESTS[test](_path(x, name) if by_name else x, *args[1:]) == wanted]

    return run


def _list(v: Any) -> list:
    if isinstance(v, (list, str, dict)):
        return list(v)
    raise TemplateError("only lists, texts and mappings are iterated")


def _indent(v: Any, width: Any = 4, first: Any = False) -> str:
    lines, pad = _text(v).split("\n"), " " * min(int(width), 100)
    return "\n".join(pad + x if x and (i or first) else x for i, x in enumerate(lines))


def _join(v: Any, sep: Any = "", attribute: Any = MISSING) -> str:
    return _text(sep).join(_text(x if attribute is MISSING else _path(x, attribute)) for x in _list(v))


_FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "title": lambda v: _text(v).title(), "capitalize": lambda v: _text(v).capitalize(),
    "length": lambda v: 0 if v is MISSING else len(v), "count": lambda v: 0 if v is MISSING else len(v), "string": _text, "tojson": _json, "list": _list, "indent": _indent, "map": _map,
    "default": lambda v, default_value="", boolean=False: default_value if v is MISSING or (boolean and not v) else v, "first": lambda v: _get(v, 0), "last": lambda v: _get(v, -1),
    "join": _join, "replace": lambda v, a, b: _text(v).replace(_text(a), _text(b)), "int": lambda v: int(v), "float": lambda v: float(v), "abs": lambda v: abs(v), "round": lambda v, precision=0: round(v, precision),
    "items": lambda v: _METHODS["items"](v), "dictsort": lambda v: [list(x) for x in sorted(v.items())], "reverse": lambda v: v[::-1], "sort": lambda v: sorted(v), "unique": lambda v: [x for i, x in enumerate(v) if x not in v[:i]],
    "select": _select(True, False), "reject": _select(False, False), "selectattr": _select(True, True), "rejectattr": _select(False, True), "safe": lambda v: v, "e": lambda v: v,
}
_FILTERS["d"] = _FILTERS["default"]
_TESTS: dict[str, Callable] = {
    "truth": lambda v: _truth(v), "defined": lambda v: v is not MISSING, "undefined": lambda v: v is MISSING, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "mapping": lambda v: isinstance(v, dict),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "sequence": lambda v: isinstance(v, (list, str)), "iterable": lambda v: isinstance(v, (list, str, dict)),
    "true": lambda v: v is True, "false": lambda v: v is False, "even": lambda v: v % 2 == 0, "odd": lambda v: v % 2 == 1,
    "eq": lambda v, x: _op("==", v, x), "equalto": lambda v, x: _op("==", v, x), "ne": lambda v, x: _op("!=", v, x), "in": lambda v, x: _op("in", v, x),
}
_TESTS_OF_TWO = ("eq", "equalto", "ne", "in")
#: Methods by name; each works on its own kinds of values alone, whatever Python's attributes are.
_METHODS: dict[str, Callable] = {
    **{k: (lambda f: lambda v, *a: f(_only(v, str), *a))(f) for k, f in {
        "strip": _strip, "lstrip": lambda v, c=None: v.lstrip(c), "rstrip": lambda v, c=None: v.rstrip(c), "upper": lambda v: v.upper(), "lower": lambda v: v.lower(), "title": lambda v: v.title(), "capitalize": lambda v: v.capitalize(),
        "startswith": lambda v, x: v.startswith(_affix(x)), "endswith": lambda v, x: v.endswith(_affix(x)), "split": lambda v, sep=None, most=-1: v.split(sep, most), "replace": lambda v, a, b: v.replace(a, b), "find": lambda v, x: v.find(x), "removeprefix": lambda v, x: v.removeprefix(x), "removesuffix": lambda v, x: v.removesuffix(x),
    }.items()},
    **{k: (lambda f: lambda v, *a: f(_only(v, dict), *a))(f) for k, f in {
        "items": lambda v: [list(x) for x in v.items()], "keys": lambda v: list(v), "values": lambda v: list(v.values()), "get": lambda v, k, other=None: v.get(k, other),
    }.items()},
}


def _only(v: Any, kind: type) -> Any:
    if not isinstance(v, kind):
        raise TemplateError(f"only a {'text' if kind is str else 'mapping'} has that method")
    return v


def _affix(x: Any) -> Any:
    return tuple(x) if isinstance(x, list) else x


def _range(*args: Any) -> list:
    made = range(*args)
    if len(made) > LONGEST:
        raise TemplateError("the range is too long")
    return list(made)


def _truth(v: Any) -> bool:
    return v is not MISSING and bool(v)


# --- Folding and compiling.


def fold(node: tuple) -> tuple:
    """The same expression with its constant parts computed."""
    kind = node[0]
    if kind in ("lit", "name"):
        return node
    if kind == "pair":
        return (kind, node[1], fold(node[2]))
    parts = [fold(x) if isinstance(x, tuple) else [fold(y) for y in x] if isinstance(x, list) else x for x in node]
    out = tuple(parts)
    if kind in ("or", "and") and out[1][0] == "lit":
        return out[2] if _truth(out[1][1]) == (kind == "and") else out[1]
    if kind == "cond" and out[1][0] == "lit":
        return out[2] if _truth(out[1][1]) else out[3]
    if kind == "op" and out[1] == "+" and out[3][0] == "lit" and isinstance(out[3][1], str) and out[2][:2] == ("op", "+") and out[2][3][0] == "lit" and isinstance(out[2][3][1], str):
        return ("op", "+", out[2][2], ("lit", out[2][3][1] + out[3][1]))
    inner = [x[2] if x[0] == "pair" else x for p in out[1:] for x in (p if isinstance(p, list) else [p]) if isinstance(x, tuple)]
    if kind not in ("call", "list", "dict") and inner and all(x[0] == "lit" for x in inner):
        try:
            value = expression(out)({})
        except _WRONG:
            return out
        return out if value is MISSING or isinstance(value, (list, dict)) else ("lit", value)
    return out


def simplify(body: list[tuple]) -> list[tuple]:
    """Statements with folded expressions, without branches that are never taken, and with neighbouring texts joined."""
    out: list[tuple] = []

    def add(s: tuple) -> None:
        if s[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s[1])
        elif s != ("text", ""):
            out.append(s)

    for s in body:
        kind = s[0]
        if kind == "put":
            e = fold(s[1])
            add(("text", _text(e[1])) if e[0] == "lit" else ("put", e))
        elif kind == "set":
            add((kind, s[1], fold(s[2])))
        elif kind == "for":
            add((kind, s[1], fold(s[2]), fold(s[3]), simplify(s[4]), simplify(s[5])))
        elif kind == "generation":
            add((kind, simplify(s[1])))
        elif kind == "if":
            arms: list = []
            for test, arm in zip(s[1::2], s[2::2]):
                test = fold(test)
                if test[0] == "lit" and not _truth(test[1]):
                    continue
                arms += [test, simplify(arm)]
                if test[0] == "lit":
                    break
            if arms and arms[0][0] == "lit":
                for x in arms[1]:
                    add(x)
            elif arms:
                add((kind, *arms))
        else:
            add(s)
    return out


def expression(node: tuple) -> Callable[[dict], Any]:
    """A closure that computes the expression from the names' values."""
    kind = node[0]
    if kind == "lit":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name, MISSING)
    if kind == "list":
        items = [expression(x) for x in node[1]]
        return lambda env: [x(env) for x in items]
    if kind == "get":
        a, b = expression(node[1]), expression(node[2])
        return lambda env: _get(a(env), b(env))
    if kind == "dict":
        items = [expression(x) for x in node[1]]
        return lambda env: {_key(k(env)): v(env) for k, v in zip(items[::2], items[1::2])}
    if kind == "slice":
        a, *bounds = expression(node[1]), *(expression(x) if x else lambda env: None for x in node[2:])

        def cut_out(env: dict) -> Any:
            v = a(env)
            if not isinstance(v, (list, str)):
                raise TemplateError("only lists and texts have parts")
            places = [x(env) for x in bounds]
            if not all(x is None or (isinstance(x, int) and not isinstance(x, bool)) for x in places):
                raise TemplateError("parts are told by whole numbers")
            return v[slice(*places)]

        return cut_out
    if kind == "op":
        sign, a, b = node[1], expression(node[2]), expression(node[3])
        return lambda env: _op(sign, a(env), b(env))
    if kind in ("and", "or"):
        a, b, wanted = expression(node[1]), expression(node[2]), kind == "and"
        return lambda env: b(env) if _truth(v := a(env)) == wanted else v
    if kind == "not":
        a = expression(node[1])
        return lambda env: not _truth(a(env))
    if kind == "cond":
        t, a, b = map(expression, node[1:])
        return lambda env: a(env) if _truth(t(env)) else b(env)
    if kind in ("is", "filter", "method"):
        table, what = {"is": (_TESTS, "test"), "filter": (_FILTERS, "filter"), "method": (_METHODS, "function")}[kind]
        if node[1] not in table:
            raise TemplateError(f"no such {what}: {node[1]}")
        f, a, more = table[node[1]], expression(node[2]), [expression(x) for x in node[3]]
        named = {p[1]: expression(p[2]) for p in (node[4] if len(node) > 4 else [])}
        if named.keys() - set(inspect.signature(f).parameters):
            raise TemplateError(f"{node[1]} has no such argument")
        return lambda env: f(a(env), *(x(env) for x in more), **{k: x(env) for k, x in named.items()})
    if kind == "call":
        args, named = [expression(x) for x in node[2]], {p[1]: expression(p[2]) for p in node[3]}
        if node[1] == "raise_exception" and len(args) == 1 and not named:

            def fail(env: dict) -> Any:
                raise TemplateError(_text(args[0](env)))

            return fail
        if node[1] in ("namespace", "dict") and not args:
            kind_ = Namespace if node[1] == "namespace" else dict
            return lambda env: kind_((k, x(env)) for k, x in named.items())
        if node[1] == "range" and 1 <= len(args) <= 3 and not named:
            return lambda env: _range(*(x(env) for x in args))
    raise TemplateError(f"no such function: {node[1]}")


def _key(v: Any) -> Any:
    if not isinstance(v, (str, int, float, bool)) and v is not None:
        raise TemplateError("a key is a text or a number")
    return v


class _Out:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)


def statements(body: list[tuple]) -> Callable[[dict, _Out], None]:
    """A closure that runs the statements."""
    steps = [_statement(s) for s in body]

    def run(env: dict, out: _Out) -> None:
        for step in steps:
            step(env, out)

    return run


def _statement(s: tuple) -> Callable[[dict, _Out], None]:
    kind = s[0]
    if kind == "text":
        text = s[1]
        return lambda env, out: out.write(text)
    if kind == "put":
        e = expression(s[1])
        return lambda env, out: out.write(_text(e(env)))
    if kind == "set":
        (name, entry), e = s[1], expression(s[2])

        def assign(env: dict, out: _Out) -> None:
            if entry is None:
                env[name] = e(env)
            elif isinstance(env.get(name), Namespace):
                env[name][entry] = e(env)
            else:
                raise TemplateError(f"{name} is no namespace")

        return assign
    if kind == "generation":
        inner = statements(s[1])

        def mark(env: dict, out: _Out) -> None:
            start = out.size
            inner(env, out)
            out.spans.append((start, out.size))

        return mark
    if kind == "if":
        arms = [(expression(t), statements(b)) for t, b in zip(s[1::2], s[2::2])]

        def choose(env: dict, out: _Out) -> None:
            for test, arm in arms:
                if _truth(test(env)):
                    return arm(env, out)

        return choose
    names, items, test, inner, other = s[1], expression(s[2]), expression(s[3]), statements(s[4]), statements(s[5])

    def bound(scope: dict, v: Any) -> dict:
        if len(names) == 1:
            return scope | {names[0]: v}
        if not isinstance(v, list) or len(v) != len(names):
            raise TemplateError(f"{len(names)} values expected")
        return scope | dict(zip(names, v))

    def loop(env: dict, out: _Out) -> None:
        values = items(env)
        if isinstance(values, dict):
            values = list(values)
        if not isinstance(values, list):
            raise TemplateError("only lists and mappings are iterated")
        scopes = [x for x in (bound(env, v) for v in values) if _truth(test(x))]
        n = len(scopes)
        kept = [x[names[0]] for x in scopes]
        for i, scope in enumerate(scopes):
            scope["loop"] = {
                "index": i + 1, "index0": i, "revindex": n - i, "revindex0": n - i - 1, "first": i == 0, "last": i == n - 1, "length": n,
                "previtem": kept[i - 1] if i else MISSING, "nextitem": kept[i + 1] if i + 1 < n else MISSING,
            }
            inner(scope, out)
        if not n:
            other(env, out)

    return loop


#: What a wrong value can raise within a closure.
_WRONG = (TypeError, ValueError, ArithmeticError, LookupError, AttributeError, RecursionError)


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from the names' values to the text and its generated spans (in characters).

    Values never give access to Python's attributes or functions. A name set
    within a loop is gone after the round; an entry of a namespace() stays. All
    that can go wrong, in the template or with a value, is a TemplateError.
    """
    try:
        run = statements(simplify(parse(source)))
    except TemplateError:
        raise
    except _WRONG as e:
        raise TemplateError("the template is nested too deeply" if isinstance(e, RecursionError) else str(e)) from e

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        try:
            run(dict(values), out)
        except TemplateError:
            raise
        except _WRONG as e:
            raise TemplateError(str(e)) from e
        return "".join(out.parts), out.spans

    return render


def renderer(source: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(source)
        for batch in batches:
            texts, spans, errors = [], [], []
            for messages in batch.column(1):
                try:
                    text, marks = render({"messages": [{"role": m["role"], "content": m["content"]} for m in messages.as_py()]})
                    error = None
                except TemplateError as e:
                    text, marks, error = None, [], str(e)
                texts.append(text)
                spans.append(",".join(f"{a}-{b}" for a, b in marks))
                errors.append(error)
            n_turns = pa.compute.list_value_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_turns, pa.array(texts, pa.string()), pa.array(spans, pa.string()), pa.array(errors, pa.string())], names=["conv_id", "n_turns", "text", "spans", "error"])

    return run


def format_chats(turns: DataFrame, template: str = CHAT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, text, spans, error.

    The turns are sorted by number, then role, then text (nulls first), so ties
    and repeated rows have one order; they are rendered by the compiled template.
    spans lists the characters between generation marks as "start-end,...". A
    template that raises for a conversation, or meets a value it cannot work on,
    gives it a null text and the error; a template that cannot be parsed raises at once.

    A null role is "user", a null text is empty. Turns without a conversation id
    are one conversation with a null id. Extra columns are not read. An empty
    table gives an empty table.
    """
    compile_template(template)
    one = F.struct(col(turn).alias("turn"), col(role).alias("role"), col(text).alias("content"))
    chats = turns.select(col(conv_id).alias("conv_id"), one.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    plain = F.transform("m", lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    kind = turns.select(col(conv_id)).schema[0].dataType.simpleString()
    return chats.select("conv_id", plain.alias("m")).mapInArrow(renderer(template), f"conv_id {kind}, n_turns long, text string, spans string, error string")
