"""Object-model language: text to a syntax tree.

    name : access
    rule : /web/*
    ---
    ip : ip = take(option:[src-ip, sip]) { _ : ip(0.0.0.0) } ;
    zone = select zone from zones where low <= ip4_int(read(ip)) and high >= ip4_int(read(ip)) ;
    level = match read(status) { in (digit(200), digit(299)) => chars(ok) ; _ => chars(bad) ; } ;
    * = take() ;
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class ModelError(ValueError):
    pass


@dataclass(frozen=True)
class Get:
    """read or take: a name, alternatives, or wildcard keys; and a default."""

    verb: str
    name: str | None = None
    option: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    default: object | None = None


@dataclass(frozen=True)
class Const:
    kind: str
    text: str


@dataclass(frozen=True)
class Now:
    what: str


@dataclass(frozen=True)
class Symbol:
    name: str


@dataclass(frozen=True)
class Pipe:
    source: object
    calls: tuple[tuple[str, tuple[str, ...], bool], ...]


@dataclass(frozen=True)
class Fmt:
    template: str
    args: tuple[Get, ...]


@dataclass(frozen=True)
class Obj:
    members: tuple[tuple[str, str | None, object], ...]


@dataclass(frozen=True)
class Collect:
    source: Get


@dataclass(frozen=True)
class Cond:
    op: str  # eq, ne, in, fun
    args: tuple = ()
    name: str = ""


@dataclass(frozen=True)
class Match:
    sources: tuple[Get, ...]
    cases: tuple[tuple[tuple[tuple[Cond, ...], ...], object], ...]
    default: object | None


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...]
    table: str
    where: object


@dataclass(frozen=True)
class Target:
    name: str
    kind: str | None = None


@dataclass(frozen=True)
class Item:
    targets: tuple[Target, ...]
    value: object


@dataclass(frozen=True)
class Model:
    name: str
    rules: tuple[str, ...]
    items: tuple[Item, ...]
    statics: tuple[Item, ...] = ()
    enabled: bool = True


#: Condition functions of match.
MATCH_FUNCTIONS = ("starts_with", "ends_with", "contains", "regex_match", "is_empty", "iequals", "gt", "lt", "eq", "in_range")
KINDS = ("auto", "ip", "chars", "digit", "float", "time", "bool", "obj", "array")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise ModelError(f"{what} expected in line {line} at {self.text[self.at : self.at + 24]!r}")

    def blank(self) -> None:
        while m := re.compile(r"\s+|(?:#|//)[^\n]*").match(self.text, self.at):
            self.at = m.end()

    def peek(self, pattern: str) -> bool:
        self.blank()
        return re.compile(pattern).match(self.text, self.at) is not None

    def match(self, pattern: str, what: str | None = None) -> str | None:
        self.blank()
        m = re.compile(pattern).match(self.text, self.at)
        if m is None:
            return self.fail(what) if what else None
        self.at = m.end()
        return m[0]

    def take(self, token: str) -> bool:
        self.blank()
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            self.fail(repr(token))

    def model(self) -> Model:
        head: dict[str, str] = {}
        while m := re.compile(r"\s*(name|rule|enable)\s*:\s*").match(self.text, self.at):
            self.at = m.end()
            stop = re.compile(r"\n\s*(?:name|rule|enable)\s*:|\n\s*---").search(self.text, self.at)
            if stop is None:
                self.fail("---")
            head[m[1]] = self.text[self.at : stop.start()].strip()
            self.at = stop.start() + 1
        if "name" not in head:
            self.fail("name")
        self.need("---")
        items, statics = [], []
        while not self.peek(r"---|$"):
            if self.match(r"static\s*\{"):
                while not self.take("}"):
                    statics.append(self.item())
                continue
            items.append(self.item())
        return Model(head["name"], tuple(head.get("rule", "").split()), tuple(items), tuple(statics), head.get("enable", "true") != "false")

    def item(self) -> Item:
        targets = self.targets()
        self.need("=")
        value = self.value()
        self.need(";")
        return Item(targets, value)

    def targets(self) -> tuple[Target, ...]:
        out = []
        while True:
            name = self.match(r"[A-Za-z_*][\w./*\-]*", "a target")
            kind = None
            if self.take(":"):
                kind = self.match(r"\w+", "a type")
                if kind not in KINDS:
                    raise ModelError(f"unknown type {kind}")
            out.append(Target(name, kind))
            if not self.take(","):
                break
        shared = out[-1].kind
        return tuple(Target(t.name, t.kind or shared) for t in out)

    def value(self) -> object:
        if self.match(r"select\b"):
            return self.select()
        if self.match(r"match\b"):
            return self.matching()
        if self.match(r"object\s*\{"):
            members = []
            while not self.take("}"):
                for t in (targets := self.targets()):
                    members.append((t.name, t.kind, None))
                self.need("=")
                v = self.simple()
                members[-len(targets) :] = [(n, k, v) for n, k, _ in members[-len(targets) :]]
                self.take(";")
            return Obj(tuple(members))
        if self.match(r"collect\b"):
            return Collect(self.get())
        if self.match(r"fmt\s*\("):
            template = self.string()
            args = []
            while self.take(","):
                args.append(self.get())
            self.need(")")
            return Fmt(template, tuple(args))
        self.match(r"pipe\b")
        return self.piped(self.simple())

    def piped(self, source: object) -> object:
        calls = []
        while self.peek(r"\|(?!\|)"):
            self.need("|")
            name = self.match(r"[A-Za-z_]\w*(?:::\w+)?", "a function")
            args, quoted = [], False
            if self.take("("):
                while not self.take(")"):
                    if self.peek("[\"']"):
                        args.append(self.string())
                        quoted = True
                    else:
                        args.append(self.match(r"[^,()\s]+", "an argument"))
                    self.take(",")
            calls.append((name, tuple(args), quoted))
        return Pipe(source, tuple(calls)) if calls else source

    def simple(self) -> object:
        if m := self.match(r"Now::(?:time|date|hour)\s*\(\s*\)"):
            return Now(m[5:].split("(")[0].strip())
        if self.peek(r"(?:read|take)\s*\(|@"):
            return self.get()
        if self.peek(r"\w+\s*\("):
            return self.const()
        return Symbol(self.match(r"[A-Za-z_]\w*", "a value"))

    def const(self) -> Const:
        kind = self.match(r"\w+", "a type")
        self.need("(")
        self.blank()
        if self.peek("[\"']"):
            text = self.string()
        else:
            text = self.match(r"[^)]*").strip()
        self.need(")")
        return Const(kind, text)

    def string(self) -> str:
        raw = self.match(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "a string")[1:-1]
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1] if m[1] in "\"'\\" else m[0]), raw)

    def get(self) -> Get:
        if self.take("@"):
            return Get("read", self.match(r"[\w./\-\[\]]+", "a name"))
        verb = self.match(r"read|take", "read or take")
        self.need("(")
        name, option, keys = None, (), ()
        while not self.take(")"):
            if m := self.match(r"(?:option|in|keys)\s*:?\s*\["):
                got = []
                while not self.take("]"):
                    got.append(self.match(r"[\w./\-*]+", "a key"))
                    self.take(",")
                if m.startswith("option"):
                    option = tuple(got)
                else:
                    keys = tuple(got)
            elif self.match(r"get\s*:"):
                name = self.match(r"[\w./\-]+", "a name")
            else:
                name = self.match(r"[\w./\-\[\]*]+", "a name")
            self.take(",")
        default = None
        if self.match(r"\{\s*_\s*:"):
            default = self.simple()
            self.take(";")
            self.need("}")
        return Get(verb, name, option, keys, default)

    def matching(self) -> Match:
        many = self.take("(")
        sources = [self.get()]
        while many and self.take(","):
            sources.append(self.get())
        if many:
            self.need(")")
        self.need("{")
        cases, default = [], None
        while not self.take("}"):
            if self.match(r"_\s*=>"):
                default = self.result()
            else:
                conds = []
                if many:
                    self.need("(")
                    conds.append(self.either())
                    while self.take(","):
                        conds.append(self.either())
                    self.need(")")
                else:
                    conds.append(self.either())
                self.need("=>")
                cases.append((tuple(conds), self.result()))
            self.take(",")
            self.take(";")
        return Match(tuple(sources), tuple(cases), default)

    def result(self) -> object:
        return Collect(self.get()) if self.match(r"collect\b") else self.simple()

    def either(self) -> tuple[Cond, ...]:
        out = [self.cond()]
        while self.peek(r"\|(?!\|)"):
            self.need("|")
            out.append(self.cond())
        return tuple(out)

    def cond(self) -> Cond:
        if self.match(r"in\s*\("):
            low = self.const()
            self.need(",")
            high = self.const()
            self.need(")")
            return Cond("in", (low, high))
        if self.take("!"):
            return Cond("ne", (self.const(),))
        if name := self.match(rf"(?:{'|'.join(MATCH_FUNCTIONS)})(?=\s*\()"):
            self.need("(")
            args = []
            while not self.take(")"):
                args.append(self.string() if self.peek("[\"']") else self.match(r"[^,()\s]+", "an argument"))
                self.take(",")
            return Cond("fun", tuple(args), name)
        if self.peek(r"\w+\s*\("):
            return Cond("eq", (self.const(),))
        return Cond("eq", (Symbol(self.match(r"[A-Za-z_]\w*", "a condition")),))

    # -- lookups: or < and < not, parentheses group

    def select(self) -> Select:
        body = self.match(r"(?is).*?\bwhere\b", "where")
        m = re.fullmatch(r"(?is)\s*(\*|[\w.]+(?:\s*,\s*[\w.]+)*)\s+from\s+([\w.]+)\s+where", body)
        if m is None:
            raise ModelError(f"a lookup is columns from one table, not {body.strip()!r}")
        return Select(tuple(c.strip().split(".")[-1] for c in m[1].split(",")), m[2], self.disjunction())

    def disjunction(self) -> object:
        out = self.conjunction()
        while self.match(r"(?i)or\b"):
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self) -> object:
        out = self.negation()
        while self.match(r"(?i)and\b"):
            out = ("and", out, self.negation())
        return out

    def negation(self) -> object:
        if self.match(r"(?i)not\b"):
            return ("not", self.negation())
        if self.peek(r"\("):
            self.need("(")
            out = self.disjunction()
            self.need(")")
            return out
        left = self.operand()
        op = self.match(r"<=|>=|!=|<>|==|=|<|>", "a comparison")
        return ("cmp", {"==": "=", "<>": "!="}.get(op, op), left, self.operand())

    def operand(self) -> object:
        if self.peek(r"(?:read|take)\s*\(|@"):
            return self.get()
        if self.peek("[\"']"):
            return Const("chars", self.string())
        if m := self.match(r"-?\d+\.\d+"):
            return Const("float", m)
        if m := self.match(r"-?\d+"):
            return Const("digit", m)
        if m := self.match(r"Now::(?:time|date|hour)\s*\(\s*\)"):
            return Now(m[5:].split("(")[0].strip())
        name = self.match(r"[A-Za-z_][\w.]*", "a column")
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.operand())
                self.take(",")
            return ("call", name, tuple(args))
        return ("column", name.split(".")[-1])


def parse_model(text: str) -> Model:
    """One model. What follows a second ``---`` (a privacy section) is read over."""
    return _Reader(text).model()
