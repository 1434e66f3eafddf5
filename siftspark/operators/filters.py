"""The filter language: fields of a hit compared with literals, joined by and / or.

    expression := term (or-word term)*      or-word: || or OR
    term       := factor (and-word factor)*  and-word: && or AND
    factor     := ( expression ) | field comparator literal

A lexer cuts the text into tokens first; the parser gives a tree; the tree becomes a Column. Text from a user
is never handed to the SQL parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BAD_FILTER, EngineError

# The fields that may be asked and the comparators.
FIELDS = ("tag", "tags", "caption", "modality", "score", "collection", "doc_id", "source_ref")
COMPARATORS = (">=", "<=", "==", "!=", ">", "<")

_TOKEN = re.compile(
    r"""\s*(?:(?P<par>[()])|(?P<or>\|\|)|(?P<and>&&)|(?P<cmp>>=|<=|==|!=|>|<)|"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<num>-?[0-9.]+|-)|(?P<word>\w+))"""
)


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    text: str
    number: float | None = None


@dataclass(frozen=True)
class Joined:
    op: str
    left: object
    right: object


def _bad(why: str) -> EngineError:
    return EngineError(BAD_FILTER, f"invalid filter: {why}")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise _bad(f"unexpected {text[at:].strip()[:10]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "word" and value.lower() in ("and", "or"):
            kind = value.lower()
        out.append(("text" if kind in ("dq", "sq") else kind, value))
        at = m.end()
    return out


def parse(text: str | None):
    """The tree of a filter, None if it is blank; EngineError 40003 otherwise."""
    tokens = _tokens(text or "")
    if not tokens:
        return None
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else "end"

    def take(kind: str, what: str) -> str:
        nonlocal at
        if peek() != kind:
            raise _bad(f"expected {what}")
        at += 1
        return tokens[at - 1][1]

    def chain(word: str, inner):
        nonlocal at
        left = inner()
        while peek() == word:
            at += 1
            left = Joined(word, left, inner())
        return left

    def factor():
        nonlocal at
        if peek() == "par" and tokens[at][1] == "(":
            at += 1
            inside = expression()
            if peek() != "par" or tokens[at][1] != ")":
                raise _bad("missing )")
            at += 1
            return inside
        field = take("word", "a field").lower()
        if field not in FIELDS:
            raise _bad(f"field {field!r} isn't allowed")
        op = take("cmp", "a comparator")
        if peek() == "text":
            return Comparison(field, op, take("text", "a literal"))
        raw = take("num", "a literal")
        try:
            return Comparison(field, op, raw, float(raw))
        except ValueError:
            return Comparison(field, op, raw)

    def expression():
        return chain("or", lambda: chain("and", factor))

    tree = expression()
    if at < len(tokens):
        raise _bad("trailing tokens")
    return tree


def _text(c: Column, op: str, want: str) -> Column:
    """Trimmed, in lower case; equal, unequal, and any other comparator: contains."""
    trim = lambda s: F.lower(F.regexp_replace(s, r"^\s+|\s+$", ""))
    got, w = trim(F.coalesce(c, F.lit(""))), F.lit(want.strip().lower())
    return got == w if op == "==" else got != w if op == "!=" else F.contains(got, w)


def _number(c: Column, op: str, want: float) -> Column:
    return {"==": c == want, "!=": c != want, ">": c > want, ">=": c >= want, "<": c < want, "<=": c <= want}[op]


def to_column(tree, score: str = "rrf") -> Column:
    """The tree as a Column over tags, scalar, caption, content, modality, collection, doc_id, source_ref and ``score``.

    tag, tags: any tag, or the scalar's tag, satisfies it (so != is true if any differs). caption: caption or content.
    score: against ``score``; a quoted literal is 0. Nulls compare like empty texts; a null scalar or tag list has no tags.
    """
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Joined):
        a, b = to_column(tree.left, score), to_column(tree.right, score)
        return (a & b) if tree.op == "and" else (a | b)
    op, want = tree.op, tree.text
    if tree.field in ("tag", "tags"):
        own = F.try_element_at("scalar", F.lit("tag"))
        return F.coalesce(F.exists("tags", lambda t: _text(t, op, want)), F.lit(False)) | (own.isNotNull() & _text(own, op, want))
    if tree.field == "caption":
        return _text(F.col("caption"), op, want) | _text(F.col("content"), op, want)
    if tree.field == "score":
        return F.coalesce(_number(F.col(score), op, tree.number or 0.0), F.lit(False))
    return _text(F.col(tree.field), op, want)


def filter_column(text: str | None, score: str = "rrf") -> Column:
    return to_column(parse(text), score)


def per_request(filters: list[str], filter_col: str = "filter", score: str = "rrf") -> Column:
    """One Column for a batch: each distinct filter text (as collected from the requests) decides its own rows; invalid ones match nothing."""
    out = F.lit(True)
    for text in filters:
        try:
            own = filter_column(text, score)
        except EngineError:
            own = F.lit(False)
        out = F.when(F.col(filter_col) == text, own).otherwise(out)
    return out
