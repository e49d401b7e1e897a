"""Parse-rule language: text to a small syntax tree.

    package /web { #[tag(kind:"access")] rule nginx { |decode/base64| (ip:src, 2*_, time/clf<[,]>, http/request", digit)\\, } }

A rule has payload steps, then groups of fields; see ``operators.interpret`` for what they mean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

GROUPS = ("alt", "opt", "some_of", "seq", "order", "not")
#: Type names and their aliases.
ALIASES = {
    "time/apache": "time/clf",
    "time/httpd": "time/clf",
    "time/nginx": "time/clf",
    "time/rfc3339": "time_3339",
    "time/rfc2822": "time_2822",
    "time/timestamp": "time_timestamp",
    "time/epoch": "time_timestamp",
    "http/user_agent": "http/agent",
    "proto/text": "proto_text",
}
TYPES = {
    "auto", "bool", "chars", "symbol", "peek_symbol", "digit", "port", "float", "hex", "sn", "_", "time", "time/clf", "time_iso", "time_3339", "time_2822",
    "time_timestamp", "ip", "ip_net", "http/method", "http/request", "http/status", "http/agent", "base64", "json", "exact_json", "kv", "kvarr", "proto_text", "array",
}
#: Types with a parser that no rule can name: using them is an error.
UNSUPPORTED = {"domain", "email", "url", "id_card", "mobile_phone", "obj"}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Separator:
    """What ends a field: a literal, or a pattern (regex, and a lookahead that is not consumed)."""

    literal: str | None = None
    pattern: str | None = None
    preserve: str | None = None

    def find(self, text: str, at: int) -> tuple[int, int] | None:
        """Where the field's text ends and where reading goes on; None if the separator is not there."""
        if self.literal is not None:
            if self.literal == "\0":
                return len(text), len(text)
            if self.literal == "\\S":
                m = re.compile("[ \t]").search(text, at)
                return m.span() if m else None
            i = text.find(self.literal, at)
            return None if i < 0 else (i, i + len(self.literal))
        m = self.compiled().search(text, at)
        return None if m is None else ((m.start("end") if m["end"] is not None else m.start()), m.end())

    def compiled(self) -> re.Pattern:
        return _compile(self.pattern + (f"(?={self.preserve})" if self.preserve else ""))

    def skip(self, text: str, at: int) -> int:
        """Reading position after the separator, if it stands here."""
        if self.literal is not None:
            if self.literal == "\0":
                return at
            if self.literal == "\\S":
                return at + (text[at : at + 1] in (" ", "\t") and at < len(text))
            return at + len(self.literal) if text.startswith(self.literal, at) else at
        m = self.compiled().match(text, at)
        return m.end() if m else at


_cache: dict[str, re.Pattern] = {}


def _compile(pattern: str) -> re.Pattern:
    if pattern not in _cache:
        _cache[pattern] = re.compile(pattern, re.S)
    return _cache[pattern]


SPACE = Separator(" ")


@dataclass(frozen=True)
class Call:
    """A pipe function with its arguments; ``not`` has a call as its argument."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Field:
    kind: str
    name: str | None = None
    repeat: int | None = 1  # None: until failure or end
    symbol: str | None = None
    subs: tuple[Field, ...] = ()
    path: str | None = None  # of a sub-field
    optional: bool = False
    length: int | None = None
    scope: tuple[str, str] | None = None
    sep: Separator | None = None
    pipes: tuple[Call | Group, ...] = ()

    @property
    def label(self) -> str:
        return self.name or self.kind


@dataclass(frozen=True)
class Group:
    kind: str
    fields: tuple[Field, ...]
    length: int | None = None
    sep: Separator | None = None


@dataclass(frozen=True)
class Rule:
    key: str
    steps: tuple[str, ...]
    groups: tuple[Group, ...]
    tags: tuple[tuple[str, str], ...] = ()
    copy_raw: str | None = None


@dataclass
class _Reader:
    text: str
    at: int = 0
    package: str = ""
    marks: dict = field(default_factory=dict)

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise RuleError(f"{what} expected in line {line} at {self.text[self.at : self.at + 24]!r}")

    def blank(self) -> None:
        while m := re.compile(r"\s+|//[^\n]*").match(self.text, self.at):
            self.at = m.end()

    def peek(self, token: str) -> bool:
        self.blank()
        return self.text.startswith(token, self.at)

    def take(self, token: str) -> bool:
        if self.peek(token):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            self.fail(repr(token))

    def match(self, pattern: str, what: str | None = None) -> str | None:
        self.blank()
        m = re.compile(pattern).match(self.text, self.at)
        if m is None:
            return self.fail(what) if what else None
        self.at = m.end()
        return m[0]

    # -- documents

    def document(self) -> list[Rule]:
        out = []
        self.blank()
        while self.at < len(self.text):
            outer = self.annotations()
            if self.take("package"):
                self.package = self.match(r"[\w./-]+", "a package name")
                self.need("{")
                while not self.take("}"):
                    out.append(self.rule({**outer, **self.annotations()}))
                self.package = ""
            else:
                out.append(self.rule(outer))
            self.blank()
        return out

    def annotations(self) -> dict:
        out: dict = {}
        while self.take("#["):
            while not self.take("]"):
                kind = self.match(r"\w+", "an annotation")
                self.need("(")
                while not self.take(")"):
                    key = self.match(r"[\w.-]+", "a key")
                    self.need(":")
                    value = self.string()
                    out[("tag", key) if kind == "tag" else (kind, "")] = value
                    self.take(",")
                self.take(",")
        return out

    def string(self) -> str:
        if self.take('r#"'):
            end = self.text.find('"#', self.at)
            out, self.at = self.text[self.at : end], end + 2
            return out
        for quote in "\"'":
            if self.peek(quote):
                raw = self.match(rf"{quote}(?:\\.|[^{quote}\\])*{quote}", "a string")[1:-1]
                return re.sub(r"\\(x[0-9a-fA-F]{2}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1]) or (chr(int(m[1][1:], 16)) if len(m[1]) == 3 else m[1]), raw)
        return self.fail("a string")

    def rule(self, notes: dict) -> Rule:
        self.need("rule")
        name = self.match(r"[\w./-]+", "a rule name")
        self.need("{")
        wrapped = bool(self.match(r"@?plg_pipe\s*\(\s*id\s*:\s*[\w./-]+\s*\)\s*\{"))
        steps = []
        if self.take("|"):
            while True:
                steps.append(self.match(r"[\w./-]+", "a step").replace(" ", ""))
                self.need("|")
                if not re.compile(r"\s*[A-Za-z]+[\w]*/[\w./-]+\s*\|").match(self.text, self.at):
                    break
        groups = [self.group()]
        while self.take(","):
            groups.append(self.group())
        if wrapped:
            self.need("}")
        self.need("}")
        key = "/".join(x.strip("/") for x in (self.package, name) if x)
        tags = tuple((k[1], v) for k, v in notes.items() if k[0] == "tag")
        raw = notes.get(("copy_raw", ""))
        return Rule("/" + key, tuple(steps), tuple(groups), tags, raw)

    def group(self) -> Group:
        kind = self.match(r"(?:alt|opt|some_of|seq|order|not)(?=\s*\()") or "seq"
        self.need("(")
        fields = []
        while not self.take(")"):
            fields.append(self.field())
            self.take(",")
        length = self.length()
        sep = self.separator()
        if length is not None:
            fields = [replace(f, length=f.length if f.length is not None else length) for f in fields]
        return Group("seq" if kind == "order" else kind, tuple(fields), length, sep)

    # -- fields

    def field(self, sub: bool = False) -> Field:
        repeat: int | None = 1
        if not sub and (m := self.match(r"\d*\*")):
            repeat = int(m[:-1]) if len(m) > 1 else None
        optional = False
        if sub and self.match(r"opt\s*\("):
            optional = True
            kind = self.type_name()
            self.need(")")
        else:
            kind = self.type_name(sub)
        symbol = None
        if kind in ("symbol", "peek_symbol") and self.text.startswith("(", self.at):
            m = re.compile(r"\(((?:\\.|[^)\\])*)\)").match(self.text, self.at)
            symbol, self.at = re.sub(r"\\(.)", r"\1", m[1]), m.end()
        subs: list[Field] = []
        if not sub and kind not in ("symbol", "peek_symbol") and self.text.startswith("(", self.at):
            self.need("(")
            while not self.take(")"):
                subs.append(self.field(sub=True))
                self.take(",")
        path = self.match(r"@\s*[\w./\-\[\]*]+")
        name = None
        if self.peek(":"):
            self.at += 1
            name = self.match(r"[\w.-]+", "a field name")
        length = self.length() if not sub else None
        scope = self.scope()
        sep = self.separator()
        pipes: list[Call | Group] = []
        while self.take("|"):
            pipes.append(self.group() if self.match(r"(?=(?:alt|opt|some_of|seq|order|not)?\s*\()(?!not\s*\(\s*\w+\s*\()") is not None else self.call())
        return Field(kind, name, repeat, symbol, tuple(subs), path[1:].strip() if path else None, optional, length, scope, sep, tuple(pipes))

    def type_name(self, sub: bool = False) -> str:
        if sub and self.peek("@"):
            return "auto_sub"
        name = self.match(r"[A-Za-z_]\w*(?:/[\w]+)?|_", "a type")
        name = ALIASES.get(name, name)
        base = name.split("/")[0] if name.startswith("array/") else name
        if base in UNSUPPORTED:
            raise RuleError(f"type {name} is not supported in rules")
        if base not in TYPES:
            raise RuleError(f"unknown type {name}")
        return name

    def length(self) -> int | None:
        m = self.match(r"\[\s*\d+\s*\]")
        return int(m[1:-1]) if m else None

    def scope(self) -> tuple[str, str] | None:
        if self.text.startswith('"', self.at):
            self.at += 1
            return '"', '"'
        m = re.compile(r"<([^,]+?),([^\s]+?)>(?=[\s,:)\\|{]|$)").match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[1], m[2]
        return None

    def separator(self) -> Separator | None:
        if m := re.compile(r"(?:\\.)+").match(self.text, self.at):
            self.at = m.end()
            body = m[0][1::2]
            known = {"0": "\0", "s": " ", "t": "\t", "n": "\n", "r": "\r", "S": "\\S"}
            return Separator(known[body] if body in known else body)
        if self.text.startswith("{", self.at):
            return self.pattern()
        return None

    def pattern(self) -> Separator:
        """A brace pattern: literal text, ``*`` (shortest), ``?``, blanks, and at the end a part that is kept."""
        at, out, kept, target, stars = self.at + 1, "", None, None, 0
        blanks = {"s": r"[ \t\r\n]+", "S": r"[^ \t\r\n]+", "h": r"[ \t]+", "H": r"[^ \t]+", "0": "\0", "n": "\n", "t": "\t", "r": "\r"}
        body = ""
        while at < len(self.text) and self.text[at] != "}":
            c = self.text[at]
            if c == "\\":
                n = self.text[at + 1]
                piece, at = blanks.get(n) or re.escape(n), at + 2
            elif c == "(":
                if kept is not None:
                    raise RuleError("a preserved part cannot hold another one")
                body, kept, at = out, "", at + 1
                out = ""
                continue
            elif c == ")":
                kept, out, at = out, body, at + 1
                if self.text[at] != "}":
                    raise RuleError("a preserved part stands only at the end of a pattern")
                continue
            elif c == "*":
                stars += 1
                if stars > 1 or kept is not None:
                    raise RuleError("a pattern has one * at most, outside its preserved part")
                piece, at = ".*?", at + 1
            else:
                piece, at = ("." if c == "?" else re.escape(c)), at + 1
            out += piece
        self.at = at + 1
        # the field's own text is what stands before the match, and what a leading * takes
        lead = out.startswith(".*?")
        out = f"(?:.*?)(?P<end>){out[3:]}" if lead else f"(?P<end>){out}"
        return Separator(pattern=out, preserve=kept or target)

    # -- pipe functions

    def call(self) -> Call:
        name = self.match(r"\w+", "a function")
        if name not in FUNCTIONS:
            raise RuleError(f"unknown function {name}")
        self.need("(")
        args: list = []
        while not self.take(")"):
            if name == "not":
                args.append(self.call())
            elif self.take("["):
                items = []
                while not self.take("]"):
                    items.append(self.argument())
                    self.take(",")
                args.append(tuple(items))
            else:
                args.append(self.argument())
            self.take(",")
        return Call(name, tuple(args))

    def argument(self) -> str:
        if self.peek('"') or self.peek("'") or self.peek('r#"'):
            return self.string()
        return self.match(r"[^,()\[\]\s]+", "an argument")


#: Field pipe functions.
FUNCTIONS = {
    "take", "last", "has", "f_has", "chars_has", "f_chars_has", "chars_not_has", "f_chars_not_has", "chars_in", "f_chars_in", "digit_has", "f_digit_has",
    "digit_in", "f_digit_in", "digit_range", "ip_in", "f_ip_in", "starts_with", "regex_match", "not", "json_unescape", "base64_decode", "chars_replace",
}


def parse_rules(text: str) -> list[Rule]:
    """All rules of a text, in order. Raises ``RuleError`` with the place of a mistake."""
    return _Reader(text).document()


def parse_rule(text: str) -> Rule:
    rules = parse_rules(text if re.match(r"\s*(#\[|package|rule)", text) else f"rule r {{ {text} }}")
    if len(rules) != 1:
        raise RuleError("one rule expected")
    return rules[0]
