"""Payload steps that run before a rule: each as a Spark expression, and as plain Python for the general path."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    column: Callable[[Column], Column]
    plain: Callable[[str], str | None]


def _base64(text: str) -> str | None:
    try:
        return base64.b64decode(text.strip(), validate=True).decode("utf-8", "replace")
    except (binascii.Error, ValueError):
        return None


def _hex(text: str) -> str | None:
    try:
        return bytes.fromhex(text.strip()).decode("utf-8", "replace")
    except ValueError:
        return None


def _text(c: Column) -> Column:
    return F.make_valid_utf8(c.cast("string"))


STEPS: dict[str, Step] = {
    "decode/base64": Step(lambda c: _text(F.try_to_binary(F.trim(c), F.lit("base64"))), _base64),
    "decode/hex": Step(lambda c: _text(F.try_to_binary(F.trim(c), F.lit("hex"))), _hex),
    # unescaped quotes go, a backslash goes and what follows stays
    "unquote/unescape": Step(lambda c: F.regexp_replace(c, r'(?s)\\(.?)|"', "$1"), lambda t: re.sub(r'(?s)\\(.?)|"', lambda m: m[1] or "", t)),
    "strip/bom": Step(lambda c: F.replace(c, F.lit("\ufeff"), F.lit("")), lambda t: t.replace("\ufeff", "")),
}


def register_step(name: str, column: Callable[[Column], Column], plain: Callable[[str], str | None]) -> None:
    """A step of one's own, named ``plg_pipe/<name>`` in rules."""
    STEPS[f"plg_pipe/{name.lower()}"] = Step(column, plain)


def step(name: str) -> Step:
    """Names are case-insensitive; an unknown one is an error when the rule is compiled."""
    found = STEPS.get(name.lower())
    if found is None:
        raise ValueError(f"unknown payload step {name}")
    return found
