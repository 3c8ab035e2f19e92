"""The query bar's language: text to a small plan of terms, then to one boolean column.

    severity:>=high sla:breached assignee:"john smith" phishing

Terms are joined by AND. What isn't a term of a known field is free text, kept in order and matched as one substring.
Nothing a user types raises.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.model import Context

OPS = (">=", "<=", ">", "<", "!")
TERM = re.compile(r"([A-Za-z]+):(.+)", re.S)


@dataclass(frozen=True)
class Term:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class CompiledQuery:
    terms: tuple[Term, ...]
    free_text: str


Matcher = Callable[[str, str, Context], Column]
_fields: dict[str, Matcher] = {}


def register_field(*names: str) -> Callable[[Matcher], Matcher]:
    """Adds a field to the language under each of the names: a function of (op, value, context) to a column."""

    def add(matcher: Matcher) -> Matcher:
        _fields.update(dict.fromkeys(names, matcher))
        compile_query.cache_clear()
        return matcher

    return add


def fields() -> tuple[str, ...]:
    return tuple(_fields)


def tokens(text: str) -> list[str]:
    """Runs between white space; double quotes hold a run together and stay in it."""
    out, current, quoted = [], "", False
    for c in text:
        quoted ^= c == '"'
        if c.isspace() and not quoted:
            out += [current] if current else []
            current = ""
        else:
            current += c
    return out + ([current] if current else [])


def unquote(text: str) -> str:
    return text.removeprefix('"').removesuffix('"')


def parse_value(raw: str) -> tuple[str, str]:
    for op in OPS:
        if raw.startswith(op):
            return op, unquote(raw[len(op) :])
    return "=", unquote(raw)


@lru_cache(maxsize=64)
def compile_query(text: str) -> CompiledQuery:
    terms, words = [], []
    for token in tokens(text.strip()):
        match = TERM.fullmatch(token)
        if match and match[1].lower() in _fields:
            op, value = parse_value(match[2])
            if value:
                terms.append(Term(match[1].lower(), op, value.lower()))
                continue
        word = unquote(token)
        words += [word] if word else []
    return CompiledQuery(tuple(terms), " ".join(words))


def terms_column(query: CompiledQuery, ctx: Context) -> Column:
    """All terms hold. An operator that a field doesn't have never matches."""
    columns = [F.coalesce(_fields[t.field](t.op, t.value, ctx), F.lit(False)) for t in query.terms]
    return reduce(lambda a, b: a & b, columns, F.lit(True))
