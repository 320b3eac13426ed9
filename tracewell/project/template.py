"""What a model's template refers to, without running it: an abstract interpreter of the template language.

A text is run twice, as a full and as an incremental build, and what both ask for is united. Values that only a
connection, a command line or the environment could tell are unknown; where a condition is unknown both branches run,
where what a loop goes over is unknown its body runs with unknown items until nothing new comes. A text that can't be
parsed is searched for literal calls.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Limits: nested calls, steps, items of a loop.
DEPTH, STEPS, ITEMS = 32, 1_000_000, 10_000
#: Times a loop over something unknown is run at most.
ROUNDS = 3
#: Names a template finds that only a run would fill.
CONTEXT = {"target", "adapter", "this", "model", "graph", "flags", "api", "schema", "database", "invocation_id", "run_started_at", "builtins", "modules", "context", "selected_resources", "project_name", "dbt_version", "exceptions"}
SECRET = "DBT_ENV_SECRET"


class TemplateError(Exception):
    pass


class Stop(Exception):
    """A path that ends by itself: return, raise_compiler_error, break, continue."""

    def __init__(self, kind: str, value: object = None) -> None:
        super().__init__(kind)
        self.kind, self.value = kind, value


class Limit(Exception):
    pass


@dataclass(frozen=True)
class Unknown:
    """A value that can't be known, and why."""

    why: str = "runtime_value_unknown"


class Undefined(Unknown):
    pass


@dataclass
class Found:
    refs: list[tuple[str | None, str, str | None]] = field(default_factory=list)  # package, name, version
    sources: list[tuple[str, str]] = field(default_factory=list)
    materialized: str | None = None
    tags: list[str] = field(default_factory=list)
    reasons: list[tuple[str, str]] = field(default_factory=list)

    def add(self, where: str, x) -> None:
        if x not in getattr(self, where):
            getattr(self, where).append(x)


# -- cutting a text into pieces

_PIECE = re.compile(r"\{#.*?#\}|\{%-?\s*raw\s*-?%\}(.*?)\{%-?\s*endraw\s*-?%\}|\{%[-+]?|\{\{-?", re.S)
_TOKEN = re.compile(r"""\s+|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<op>\*\*|//|==|!=|<=|>=|-?%\}|-?\}\}|[-+*/%~<>=()\[\]{}.,:|])""", re.S)


def pieces(text: str) -> list[tuple[str, object]]:
    """('text', str), ('expr', tokens) and ('tag', tokens), in order."""
    out: list[tuple[str, object]] = []
    at = 0
    while m := _PIECE.search(text, at):
        if "{#" in text[at : m.start()]:
            raise TemplateError("a comment isn't closed")
        if m.start() > at:
            out.append(("text", text[at : m.start()]))
        at = m.end()
        if m[0].startswith("{#"):
            continue
        if m[1] is not None or "raw" in m[0]:
            out.append(("text", m[1] or ""))
            continue
        expr = m[0].startswith("{{")
        tokens, depth = [], 0
        while True:
            t = _TOKEN.match(text, at)
            if not t:
                raise TemplateError(f"unexpected character at {at}")
            at = t.end()
            if t.lastgroup is None:
                continue
            if t.lastgroup == "op":
                if depth == 0 and t[0].endswith("}}" if expr else "%}"):
                    break
                if t[0] in ("}}", "-}}"):  # two brackets of a nested mapping
                    at -= 1
                    tokens.append(("op", "}"))
                    depth -= 1
                    continue
                depth += t[0] in "([{" and len(t[0]) == 1
                depth -= t[0] in ")]}" and len(t[0]) == 1
            tokens.append((t.lastgroup, t[0]))
        out.append(("expr" if expr else "tag", tokens))
    if text[at:].find("{%") >= 0 or text[at:].find("{#") >= 0:
        raise TemplateError("a tag isn't closed")
    out.append(("text", text[at:]))
    return out


# -- expressions: nested tuples (kind, ...)


class Expr:
    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.t, self.i = [*tokens, ("end", "")], 0

    def at(self, *words: str) -> bool:
        return all(self.t[min(self.i + k, len(self.t) - 1)][1] == w and self.t[min(self.i + k, len(self.t) - 1)][0] != "str" for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"expected {word}, found {self.t[self.i][1] or 'the end'}")

    def name(self) -> str:
        kind, text = self.t[self.i]
        if kind != "name":
            raise TemplateError(f"expected a name, found {text or 'the end'}")
        self.i += 1
        return text

    def done(self) -> None:
        if self.t[self.i][0] != "end":
            raise TemplateError(f"unexpected {self.t[self.i][1]}")

    def tuple_(self) -> tuple:
        first = self.expr()
        if not self.at(","):
            return first
        items = [first]
        while self.take(","):
            if self.t[self.i][0] == "end" or self.at(")"):
                break
            items.append(self.expr())
        return ("list", items)

    def expr(self) -> tuple:
        e = self.binary(0)
        while self.take("if"):
            c = self.binary(0)
            e = ("choose", c, e, self.expr() if self.take("else") else ("const", None))
        return e

    LEVELS = [("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("*", "/", "//", "%"), ("**",)]

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        if self.LEVELS[level] == ("not",):
            return ("not", self.binary(level)) if self.take("not") else self.binary(level + 1)
        e = self.binary(level + 1)
        while True:
            if level == 3 and self.take("not", "in"):
                e = ("not", ("op", "in", e, self.binary(level + 1)))
                continue
            op = next((o for o in self.LEVELS[level] if self.at(o)), None)
            if op is None:
                return e
            self.i += 1
            e = ("op", op, e, self.binary(level + 1))

    def unary(self) -> tuple:
        if self.take("-"):
            return ("op", "-", ("const", 0), self.unary())
        if self.take("+"):
            return self.unary()
        return self.postfix(self.primary())

    def postfix(self, e: tuple) -> tuple:
        while True:
            if self.take("."):
                kind, text = self.t[self.i]
                self.i += 1
                e = ("attr", e, text if kind == "name" else int(text))
            elif self.take("["):
                if self.at(":"):
                    start = None
                else:
                    start = self.expr()
                if self.take(":"):
                    end = None if self.at("]") else self.expr()
                    e = ("slice", e, start, end)
                else:
                    e = ("item", e, start)
                self.need("]")
            elif self.at("("):
                e = ("call", e, *self.args())
            elif self.take("|"):
                n = self.name()
                e = ("filter", n, e, *(self.args() if self.at("(") else ([], {})))
            elif self.at("is"):
                self.i += 1
                no = self.take("not")
                n = self.name()
                a = self.args()[0] if self.at("(") else [self.primary()] if self.t[self.i][0] in ("str", "num") else []
                e = ("test", n, e, a)
                e = ("not", e) if no else e
            else:
                return e

    def args(self) -> tuple[list, dict]:
        self.need("(")
        args, kwargs = [], {}
        while not self.take(")"):
            if self.take("**"):
                kwargs.setdefault("**", []).append(self.expr())
            elif self.take("*"):
                args.append(("splat", self.expr()))
            elif self.t[self.i][0] == "name" and self.t[self.i + 1][1] == "=":
                n = self.name()
                self.need("=")
                kwargs[n] = self.expr()
            else:
                args.append(self.expr())
            if not self.take(","):
                self.need(")")
                break
        return args, kwargs

    def primary(self) -> tuple:
        kind, text = self.t[self.i]
        self.i += 1
        if kind == "num":
            return ("const", float(text) if "." in text else int(text))
        if kind == "str":
            out = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S)
            while self.t[self.i][0] == "str":
                out += self.t[self.i][1][1:-1]
                self.i += 1
            return ("const", out)
        if kind == "name":
            if text in ("true", "True", "false", "False", "none", "None"):
                return ("const", {"t": True, "f": False, "n": None}[text[0].lower()])
            return ("name", text)
        if text == "(":
            if self.take(")"):
                return ("list", [])
            e = self.tuple_()
            self.need(")")
            return e
        if text == "[":
            items = []
            while not self.take("]"):
                items.append(self.expr())
                if not self.take(","):
                    self.need("]")
                    break
            return ("list", items)
        if text == "{":
            pairs = []
            while not self.take("}"):
                k = self.expr()
                self.need(":")
                pairs.append((k, self.expr()))
                if not self.take(","):
                    self.need("}")
                    break
            return ("dict", pairs)
        raise TemplateError(f"unexpected {text or 'end'}")


# -- statements: ('text', str), ('emit', expr), (tag, ...)

_ENDS = {"if": "endif", "for": "endfor", "macro": "endmacro", "call": "endcall", "filter": "endfilter", "set": "endset", "with": "endwith", "autoescape": "endautoescape", "snapshot": "endsnapshot", "test": "endtest", "materialization": "endmaterialization", "docs": "enddocs", "block": "endblock"}


class Statements:
    def __init__(self, text: str) -> None:
        self.p, self.i = pieces(text), 0

    def body(self, *ends: str) -> tuple[list, list | None]:
        """(statements, the tag that ended them)."""
        out = []
        while self.i < len(self.p):
            kind, x = self.p[self.i]
            self.i += 1
            if kind == "text":
                out.append(("text", x))
            elif kind == "expr":
                e = Expr(x)
                out.append(("emit", e.tuple_()))
                e.done()
            else:
                if not x or x[0][0] != "name":
                    raise TemplateError("a tag has no name")
                if x[0][1] in ends:
                    return out, x
                out.append(self.tag(x))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, None

    def tag(self, x: list) -> tuple:
        word, e = x[0][1], Expr(x[1:])
        if word == "if":
            arms, cond = [], e.expr()
            while True:
                body, end = self.body("elif", "else", "endif")
                arms.append((cond, body))
                if end[0][1] == "endif":
                    return ("if", arms)
                cond = Expr(end[1:]).expr() if end[0][1] == "elif" else None
        if word == "for":
            names = [e.name()]
            while e.take(","):
                names.append(e.name())
            e.need("in")
            over = e.binary(0)
            if e.at(","):
                raise TemplateError("a loop goes over one thing")
            test = e.expr() if e.take("if") else None
            e.take("recursive")
            body, end = self.body("else", "endfor")
            other = self.body("endfor")[0] if end[0][1] == "else" else []
            return ("for", names, over, test, body, other)
        if word == "set":
            names = [e.name()]
            while e.take(","):
                names.append(e.name())
            attr = e.name() if e.take(".") else None
            if e.take("="):
                return ("set", names, attr, e.tuple_())
            return ("setblock", names[0], self.body("endset")[0])
        if word in ("macro", "test", "materialization", "data_test"):
            name = e.name()
            params = []
            if e.take("("):
                while not e.take(")"):
                    n = e.name()
                    params.append((n, e.expr() if e.take("=") else None))
                    e.take(",")
            return ("macro", ("test_" if word != "macro" else "") + name, params, self.body(_ENDS.get(word, "end" + word))[0])
        if word == "call":
            params = []
            if e.take("("):
                while not e.take(")"):
                    n = e.name()
                    params.append((n, e.expr() if e.take("=") else None))
                    e.take(",")
            return ("callblock", params, e.expr(), self.body("endcall")[0])
        if word == "filter":
            return ("body", self.body("endfilter")[0])
        if word == "with":
            sets = []
            while e.t[e.i][0] != "end":
                n = e.name()
                e.need("=")
                sets.append((n, e.expr()))
                e.take(",")
            return ("with", sets, self.body("endwith")[0])
        if word == "docs":
            self.body("enddocs")
            return ("text", "")
        if word in ("snapshot", "autoescape", "block"):
            return ("body", self.body(_ENDS[word])[0])
        if word == "do":
            return ("emit", e.tuple_())
        if word in ("break", "continue"):
            return (word,)
        raise TemplateError(f"unknown tag {word}")


@dataclass
class Macro:
    params: list
    body: list
    scope: dict


class Namespace(dict):
    pass


def library(texts: list[str]) -> dict[str, Macro]:
    """Macros by name of the texts, the first of a name wins; texts that can't be parsed give none."""
    out: dict[str, Macro] = {}
    for text in texts:
        try:
            body, _ = Statements(text).body()
        except (TemplateError, IndexError, ValueError):
            continue
        for s in body:
            if s[0] == "macro":
                out.setdefault(s[1], Macro(s[2], s[3], {}))
    return out


def known(x: object) -> bool:
    if isinstance(x, Unknown):
        return False
    if isinstance(x, list | tuple):
        return all(map(known, x))
    return all(map(known, x.values())) if isinstance(x, dict) else True


class Interpreter:
    def __init__(self, macros: dict[str, Macro], variables: dict, incremental: bool, found: Found) -> None:
        self.macros, self.variables, self.incremental, self.found = macros, variables, incremental, found
        self.steps = self.depth = self.maybe = 0

    def run(self, body: list) -> None:
        try:
            self.body(body, {})
        except Stop:
            pass
        except (Limit, RecursionError):
            self.found.add("reasons", ("analysis_limit_reached", ""))

    def reason(self, kind: str, detail: str = "") -> None:
        self.found.add("reasons", (kind, detail))

    # -- statements

    def body(self, body: list, scope: dict) -> str | Unknown:
        out: list = []
        for s in body:
            self.steps += 1
            if self.steps > STEPS:
                raise Limit
            out.append(self.statement(s, scope))
        return "".join(map(str, out)) if all(map(known, out)) else Unknown()

    def branch(self, body: list, scope: dict) -> object:
        """A body that may or may not run: its own end ends nothing else, and what it sets may be so."""
        before, held = dict(scope), self.maybe
        self.maybe += 1
        try:
            out = self.body(body, scope)
        except Stop:
            out = Unknown()
        finally:
            self.maybe = held
        for k, v in list(scope.items()):
            if k not in before or before[k] is not v and before[k] != v:
                scope[k] = Unknown("control_flow")
        return out

    def statement(self, s: tuple, scope: dict) -> object:
        kind = s[0]
        if kind == "text":
            return s[1]
        if kind == "emit":
            v = self.value(s[1], scope)
            return "" if v is None else v
        if kind == "body":
            return self.body(s[1], scope)
        if kind == "if":
            out, sure = [], True
            for cond, body in s[1]:
                c = True if cond is None else self.value(cond, scope)
                if isinstance(c, Unknown) and not isinstance(c, Undefined):
                    out.append(self.branch(body, scope))
                    sure = False
                elif not isinstance(c, Undefined) and c:
                    if sure:
                        return self.body(body, scope)
                    self.branch(body, scope)
                    break
            return "" if sure else Unknown()
        if kind == "for":
            return self.loop(s, scope)
        if kind == "set":
            v = self.value(s[3], scope)
            if s[2] is not None:
                target = scope.get(s[1][0])
                if isinstance(target, Namespace):
                    target[s[2]] = Unknown("control_flow") if self.maybe else v
            elif len(s[1]) == 1:
                scope[s[1][0]] = v
            else:
                many = list(v) if isinstance(v, list | tuple) and len(v) == len(s[1]) else [Unknown()] * len(s[1])
                scope.update(zip(s[1], many, strict=True))
            return ""
        if kind == "setblock":
            scope[s[1]] = self.body(s[2], scope)
            return ""
        if kind == "macro":
            scope[s[1]] = Macro(s[2], s[3], scope)
            return ""
        if kind == "callblock":
            inner = {"caller": Macro(s[1], s[3], scope)}
            return self.value(s[2], scope | inner)
        if kind == "with":
            return self.body(s[2], scope | {n: self.value(e, scope) for n, e in s[1]})
        raise Stop(kind)

    def loop(self, s: tuple, scope: dict) -> object:
        _, names, over, test, body, other = s
        items = self.value(over, scope)
        if isinstance(items, Unknown):
            for _ in range(ROUNDS):
                before = (len(self.found.refs), len(self.found.sources), len(self.found.reasons))
                inner = scope | {n: Unknown("runtime_value_unknown") for n in names} | {"loop": Unknown("loop")}
                self.branch(body, inner)
                for k in scope:
                    scope[k] = inner[k]
                if before == (len(self.found.refs), len(self.found.sources), len(self.found.reasons)):
                    break
            if other:
                self.branch(other, scope)
            return Unknown()
        items = list(items) if isinstance(items, list | tuple | dict | str | range) else []
        if len(items) > ITEMS:
            raise Limit
        out, ran = [], False
        for at, item in enumerate(items):
            many = list(item) if len(names) > 1 and isinstance(item, list | tuple) else [item]
            bound = dict(zip(names, many if len(many) == len(names) else [Unknown()] * len(names), strict=True))
            inner = scope | bound | {"loop": {"index": at + 1, "index0": at, "first": at == 0, "last": at == len(items) - 1, "length": len(items), "revindex": len(items) - at}}
            if test is not None:
                c = self.value(test, inner)
                if not isinstance(c, Unknown) and not c:
                    continue
            ran = True
            try:
                out.append(self.body(body, inner))
            except Stop as e:
                if e.kind == "break":
                    break
                if e.kind != "continue":
                    raise
        if not ran and other:
            return self.body(other, scope)
        return "".join(map(str, out)) if all(map(known, out)) else Unknown()

    # -- values

    def value(self, e: tuple, scope: dict) -> object:
        self.steps += 1
        if self.steps > STEPS:
            raise Limit
        kind = e[0]
        if kind == "const":
            return e[1]
        if kind == "name":
            if e[1] in scope:
                return scope[e[1]]
            if e[1] in self.macros:
                return self.macros[e[1]]
            if e[1] == "execute":
                return False
            if e[1] in BUILTINS or e[1] in CONTEXT:
                return ("builtin", e[1]) if e[1] in BUILTINS else Unknown(e[1])
            return Undefined(e[1])
        if kind == "list":
            return [self.value(x, scope) for x in e[1]]
        if kind == "dict":
            pairs = [(self.value(k, scope), self.value(v, scope)) for k, v in e[1]]
            return dict(pairs) if all(isinstance(k, str | int | float | bool | None) for k, _ in pairs) else Unknown()
        if kind == "not":
            v = self.value(e[1], scope)
            return v if isinstance(v, Unknown) and not isinstance(v, Undefined) else isinstance(v, Undefined) or not v
        if kind == "choose":
            c = self.value(e[1], scope)
            if isinstance(c, Unknown) and not isinstance(c, Undefined):
                a, b = self.value(e[2], scope), self.value(e[3], scope)
                return a if a == b else Unknown(c.why)
            return self.value(e[2] if c and not isinstance(c, Undefined) else e[3], scope)
        if kind == "op":
            return self.operator(e, scope)
        if kind == "attr":
            return self.attribute(self.value(e[1], scope), e[2], e, scope)
        if kind in ("item", "slice"):
            v = self.value(e[1], scope)
            a = [None if x is None else self.value(x, scope) for x in e[2:]]
            if isinstance(v, Unknown) or not all(map(known, a)):
                return Unknown()
            try:
                return v[a[0]] if kind == "item" else v[a[0] : a[1]]
            except (KeyError, IndexError, TypeError):
                return Undefined("item")
        if kind == "call":
            return self.call(e, scope)
        if kind == "filter":
            return self.filter(e, scope)
        return self.test(e, scope)

    def operator(self, e: tuple, scope: dict) -> object:
        _, op, a, b = e
        x = self.value(a, scope)
        if op in ("and", "or"):
            truth = not isinstance(x, Undefined) and bool(x) if not isinstance(x, Unknown) or isinstance(x, Undefined) else None
            if truth is None:
                self.value(b, scope)
                return Unknown()
            return x if truth == (op == "or") else self.value(b, scope)
        y = self.value(b, scope)
        if isinstance(x, Unknown) or isinstance(y, Unknown):
            return Unknown((x if isinstance(x, Unknown) else y).why)
        try:
            if op == "~":
                return f"{x}{y}"
            if op == "in":
                return x in y
            return {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y, "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "//": lambda: x // y, "%": lambda: x % y, "**": lambda: x**y}[op]()
        except (TypeError, ValueError, ZeroDivisionError, OverflowError):
            return Unknown()

    def attribute(self, v: object, name: object, e: tuple, scope: dict) -> object:
        if isinstance(v, tuple) and v[:1] == ("builtin",):
            return ("method", v, name)
        if isinstance(v, Unknown):
            if e[1] == ("name", "adapter") and name == "dispatch" or e[1] == ("name", "exceptions"):
                return ("builtin", {"dispatch": "adapter.dispatch"}.get(name, name))
            if isinstance(v, Undefined) and e[1][0] == "name" and name in self.macros:
                return self.macros[name]  # a package's macro
            return Unknown(v.why)
        if isinstance(v, dict) and name in v:
            return v[name]
        return ("method", v, name)

    def arguments(self, e: tuple, scope: dict) -> tuple[list, dict]:
        args: list = []
        for a in e[2]:
            if a[0] == "splat":
                v = self.value(a[1], scope)
                args += v if isinstance(v, list) else [Unknown()]
            else:
                args.append(self.value(a, scope))
        kwargs = {k: self.value(v, scope) for k, v in e[3].items() if k != "**"}
        for x in e[3].get("**", []):
            v = self.value(x, scope)
            kwargs |= v if isinstance(v, dict) else {}
        return args, kwargs

    def call(self, e: tuple, scope: dict) -> object:
        f = self.value(e[1], scope)
        args, kwargs = self.arguments(e, scope)
        if isinstance(f, Macro):
            return self.macro(f, args, kwargs, scope)
        if isinstance(f, tuple) and f[:1] == ("builtin",):
            return BUILTINS[f[1]](self, args, kwargs)
        if isinstance(f, tuple) and f[:1] == ("method",):
            return self.method(f[1], f[2], args, kwargs)
        if isinstance(f, Undefined):
            self.reason("unresolved_call", f.why)
        return Unknown(f.why if isinstance(f, Unknown) else "call")

    def macro(self, m: Macro, args: list, kwargs: dict, scope: dict) -> object:
        self.depth += 1
        if self.depth > DEPTH:
            raise Limit
        try:
            inner = dict(m.scope)
            for k, (n, default) in enumerate(m.params):
                inner[n] = args[k] if k < len(args) else kwargs[n] if n in kwargs else self.value(default, inner) if default is not None else Undefined(n)
            names = {n for n, _ in m.params}
            inner["varargs"], inner["kwargs"] = args[len(m.params) :], {k: v for k, v in kwargs.items() if k not in names}
            if "caller" in scope and "caller" not in inner:
                inner["caller"] = scope["caller"]
            try:
                return self.body(m.body, inner)
            except Stop as e:
                if e.kind != "return":
                    raise
                return e.value
        finally:
            self.depth -= 1

    def method(self, v: object, name: str, args: list, kwargs: dict) -> object:
        if isinstance(v, tuple) and v[:1] == ("builtin",):
            return Unknown(f"{v[1]}.{name}")
        if not known(v) or not known(args):
            if isinstance(v, list) and name == "append":
                v.append(args[0] if args else Unknown())
                return None
            return Unknown()
        if isinstance(v, list) and name in ("append", "extend", "insert"):
            getattr(v, name)(*args)
            return None
        if isinstance(v, dict) and name == "update":
            v.update(*args, **kwargs)
            return None
        if isinstance(v, dict) and name in ("items", "keys", "values"):
            return [list(x) if name == "items" else x for x in getattr(v, name)()]
        if isinstance(v, str | list | dict) and not name.startswith("_"):
            try:
                return getattr(v, name)(*args, **kwargs)
            except (AttributeError, TypeError, ValueError, KeyError, IndexError):
                return Unknown()
        return Unknown()

    def filter(self, e: tuple, scope: dict) -> object:
        v = self.value(e[2], scope)
        args, kwargs = self.arguments(("", "", e[3], e[4]), scope)
        name = e[1]
        if name in ("default", "d"):
            return (args[0] if args else "") if isinstance(v, Undefined) or v is None or not v and len(args) > 1 and args[1] is True else v
        if not known(v) or not known(args):
            return Unknown()
        try:
            simple = {"upper": lambda: str(v).upper(), "lower": lambda: str(v).lower(), "trim": lambda: str(v).strip(), "length": lambda: len(v), "count": lambda: len(v), "list": lambda: list(v), "string": lambda: str(v), "int": lambda: int(v), "float": lambda: float(v), "first": lambda: v[0], "last": lambda: v[-1], "join": lambda: (args[0] if args else "").join(map(str, v)), "replace": lambda: str(v).replace(str(args[0]), str(args[1])), "sort": lambda: sorted(v), "reverse": lambda: v[::-1], "unique": lambda: list(dict.fromkeys(v)), "capitalize": lambda: str(v).capitalize(), "title": lambda: str(v).title(), "abs": lambda: abs(v), "sum": lambda: sum(v), "min": lambda: min(v), "max": lambda: max(v), "as_text": lambda: v, "as_bool": lambda: v, "as_native": lambda: v, "as_number": lambda: v, "safe": lambda: v, "items": lambda: [list(x) for x in v.items()]}
            return simple[name]() if name in simple else Unknown(name)
        except (TypeError, ValueError, IndexError, AttributeError, KeyError):
            return Unknown()

    def test(self, e: tuple, scope: dict) -> object:
        v = self.value(e[2], scope)
        if e[1] in ("defined", "undefined"):
            if isinstance(v, Unknown) and not isinstance(v, Undefined):
                return Unknown()
            return isinstance(v, Undefined) == (e[1] == "undefined")
        if isinstance(v, Unknown):
            return Unknown()
        a = [self.value(x, scope) for x in e[3]]
        try:
            tests = {"none": lambda: v is None, "string": lambda: isinstance(v, str), "number": lambda: isinstance(v, int | float) and not isinstance(v, bool), "mapping": lambda: isinstance(v, dict), "sequence": lambda: isinstance(v, list | str | dict), "iterable": lambda: isinstance(v, list | str | dict), "odd": lambda: v % 2 == 1, "even": lambda: v % 2 == 0, "true": lambda: v is True, "false": lambda: v is False, "boolean": lambda: isinstance(v, bool), "integer": lambda: isinstance(v, int) and not isinstance(v, bool), "divisibleby": lambda: v % a[0] == 0, "equalto": lambda: v == a[0], "in": lambda: v in a[0]}
            return tests[e[1]]() if e[1] in tests else Unknown(e[1])
        except (TypeError, ZeroDivisionError, IndexError):
            return Unknown()


def version_text(v: object) -> str | None:
    """A version as it is written in ids: '02' is 2."""
    if v is None:
        return None
    return str(int(v)) if str(v).isdigit() else str(v)


def _ref(it: Interpreter, args: list, kwargs: dict) -> object:
    if not 1 <= len(args) <= 2 or set(kwargs) - {"version", "v"}:
        it.reason("invalid_dependency_call", "ref")
        return Unknown("ref")
    version = kwargs.get("version", kwargs.get("v"))
    if not known(args) or isinstance(version, Unknown):
        bad = next(a for a in [*args, version] if isinstance(a, Unknown))
        it.reason("unresolved_ref", bad.why)
        return Unknown("ref")
    if not all(isinstance(a, str) for a in args):
        it.reason("invalid_dependency_call", "ref")
        return Unknown("ref")
    it.found.add("refs", (args[0] if len(args) == 2 else None, args[-1], version_text(version)))
    return Unknown("ref")


def _source(it: Interpreter, args: list, kwargs: dict) -> object:
    if len(args) != 2 or kwargs:
        it.reason("invalid_dependency_call", "source")
    elif not known(args):
        it.reason("unresolved_source", next(a for a in args if isinstance(a, Unknown)).why)
    elif not all(isinstance(a, str) for a in args):
        it.reason("invalid_dependency_call", "source")
    else:
        it.found.add("sources", (args[0], args[1]))
    return Unknown("source")


def _var(it: Interpreter, args: list, kwargs: dict) -> object:
    if args and isinstance(args[0], str) and args[0] in it.variables:
        return it.variables[args[0]]
    if len(args) > 1 or "default" in kwargs:
        return args[1] if len(args) > 1 else kwargs["default"]
    return Unknown(f"var {args[0]}" if args and isinstance(args[0], str) else "var")


def _env_var(it: Interpreter, args: list, kwargs: dict) -> object:
    secret = args and isinstance(args[0], str) and args[0].startswith(SECRET)
    return args[1] if len(args) > 1 and not secret else Unknown("env_var")


def _config(it: Interpreter, args: list, kwargs: dict) -> object:
    for x in args:
        kwargs = (x if isinstance(x, dict) else {}) | kwargs
    if "materialized" in kwargs:
        v = kwargs["materialized"]
        it.found.materialized = v if isinstance(v, str) and not it.maybe else None
    if "tags" in kwargs and not it.maybe:
        tags = kwargs["tags"]
        for t in tags if isinstance(tags, list) else [tags]:
            if isinstance(t, str):
                it.found.add("tags", t)
    return ""


def _return(it: Interpreter, args: list, kwargs: dict) -> object:
    raise Stop("return", args[0] if args else None)


def _raise(it: Interpreter, args: list, kwargs: dict) -> object:
    raise Stop("raised")


def _dispatch(it: Interpreter, args: list, kwargs: dict) -> object:
    it.reason("unsupported_dispatch", args[0] if args and isinstance(args[0], str) else "")
    return Unknown("dispatch")


def _range(it: Interpreter, args: list, kwargs: dict) -> object:
    if not known(args) or not all(isinstance(a, int) for a in args) or not args:
        return Unknown("range")
    if len(range(*args)) > ITEMS:
        raise Limit
    return list(range(*args))


#: What a template may call.
BUILTINS = {
    "ref": _ref, "source": _source, "var": _var, "env_var": _env_var, "config": _config, "return": _return,
    "is_incremental": lambda it, a, k: it.incremental, "log": lambda it, a, k: "", "print": lambda it, a, k: "",
    "statement": lambda it, a, k: "", "run_query": lambda it, a, k: Unknown("run_query"), "load_result": lambda it, a, k: Unknown("load_result"),
    "namespace": lambda it, a, k: Namespace(k), "dict": lambda it, a, k: dict(k), "range": _range, "adapter.dispatch": _dispatch,
    "raise_compiler_error": _raise, "warn": lambda it, a, k: "", "should_full_refresh": lambda it, a, k: Unknown("should_full_refresh"),
    "doc": lambda it, a, k: "", "tojson": lambda it, a, k: Unknown("tojson"), "fromjson": lambda it, a, k: Unknown("fromjson"),
    "toyaml": lambda it, a, k: Unknown("toyaml"), "fromyaml": lambda it, a, k: Unknown("fromyaml"), "set": lambda it, a, k: list(dict.fromkeys(a[0])) if a and isinstance(a[0], list) and known(a[0]) else Unknown("set"),
    "zip": lambda it, a, k: [list(x) for x in zip(*a, strict=False)] if all(isinstance(x, list) for x in a) else Unknown("zip"), "local_md5": lambda it, a, k: Unknown("local_md5"),
}

_STRIP = re.compile(r"\{#.*?#\}|\{%-?\s*raw\s*-?%\}.*?\{%-?\s*endraw\s*-?%\}|--[^\n]*", re.S)
_LITERAL = re.compile(r"""\b(ref|source)\s*\(\s*(['"])([^'"]+)\2\s*(?:,\s*(['"])([^'"]+)\4\s*)?\)""")
_CONFIG = re.compile(r"""materialized\s*=\s*['"](\w+)['"]""")


def recovered(text: str) -> Found:
    """Literal calls in a text that can't be parsed."""
    out = Found(reasons=[("jinja_render_failed", "")])
    for block in re.findall(r"\{[{%](.*?)(?:[}%]\}|$)", _STRIP.sub(" ", text), re.S):
        for m in _LITERAL.finditer(block):
            if m[1] == "ref":
                out.add("refs", (m[3] if m[5] else None, m[5] or m[3], None))
            elif m[5]:
                out.add("sources", (m[3], m[5]))
        if m := _CONFIG.search(block):
            out.materialized = m[1]
    return out


def extract(text: str, macros: dict[str, Macro] | None = None, variables: dict | None = None) -> Found:
    """Refs and sources in the order of their first call, config of the full build, and why anything is unsure."""
    try:
        body, _ = Statements(text).body()
    except (TemplateError, IndexError, ValueError, RecursionError):
        return recovered(text)
    out = Found()
    Interpreter(macros or {}, variables or {}, False, out).run(body)
    again = Found()
    Interpreter(macros or {}, variables or {}, True, again).run(body)
    for what in ("refs", "sources", "reasons"):
        for x in getattr(again, what):
            out.add(what, x)
    return out


def select_columns(text: str) -> list[str]:
    """Best effort: the names of the last SELECT's outputs, templates aside; * stays, what has no name is left out."""
    from tracewell.sql import parser as P
    from tracewell.sql.dialects import DIALECTS
    from tracewell.sql.lexer import SqlError

    plain = re.sub(r"\{#.*?#\}|\{%.*?%\}", " ", text, flags=re.S)
    plain = re.sub(r"\{\{.*?\}\}", " jinja_value ", plain, flags=re.S)
    plain = re.sub(r"^(\s*jinja_value\s)+", "", plain)
    try:
        found = [s.query for s in P.parse(plain, DIALECTS["generic"]) if s.query is not None]
    except (SqlError, RecursionError):
        return []
    body = found[-1].body if found else None
    while isinstance(body, P.SetOp):
        body = body.right.body
    if not isinstance(body, P.Select):
        return []
    names = [alias[0] if alias else "*" if isinstance(e, P.Star) else e.parts[-1][0] if isinstance(e, P.Col) else e.name if isinstance(e, P.Func) else "" for e, alias in body.items]
    return [n for n in names if n]
