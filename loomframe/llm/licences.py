"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser
evaluates the and/or/with expressions that follow a tag.

Texts are reduced to their words (A-Z lower-cased; runs of digits, letters and characters beyond
ASCII), joined by single blanks. The automaton runs over that string, so every hit is a place
where a phrase's words stand consecutively, whatever stands between them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomframe.llm._common import ALNUM_TABLE, columns_of, map_bytes

# Base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "all rights reserved": "proprietary",
    "bsd license": "bsd",
    "boost software license": "bsl",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "unlicense": "unlicense",
}
# Tags before an expression, as words.
TAG_PHRASES = ("spdx license identifier", "license expression")
# Families of identifiers, by their first part.
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc0", "unlicense", "zlib", "bsl", "0bsd", "cc"}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_HEAD = rb"(?:spdx[-_ ]license[-_ ]identifier|license[-_ ]expression)\s*[:=]"
#: An expression ends with its line, or before the next tag.
_TAG = re.compile(_HEAD + rb"\s*((?:(?!" + _HEAD + rb")[^\n\r])*)")
_PART = re.compile(r"[()]|[a-z0-9][a-z0-9.+:_-]*")


@dataclass
class Expression:
    """What an expression says: its labels, the exceptions after with, and whether some choice of
    or-branches needs permissive licences only."""

    labels: set[str] = field(default_factory=set)
    exceptions: set[str] = field(default_factory=set)
    permissive: bool = False


def label_of(identifier: str) -> str:
    """gpl-2.0-only and gpl-3.0+ give gpl; cc-by-nc-4.0 gives cc-by-nc."""
    parts = []
    for part in re.split(r"[-+:_]", identifier.rstrip(".")):
        if not part or part[0].isdigit() and parts:
            break
        parts.append(part)
    name = "-".join(parts)
    return name.removesuffix("-only").removesuffix("-or-later") or identifier


def to_postfix(parts: list[str]) -> list[str]:
    """Shunting-yard. Raises ValueError for what is not an expression."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for part in parts:
        if part == "(":
            if not operand_next:
                raise ValueError("a parenthesis after an operand")
            stack.append(part)
        elif part == ")":
            if operand_next:
                raise ValueError("a parenthesis after an operator")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced")
            stack.pop()
        elif part in PRECEDENCE:
            if operand_next:
                raise ValueError("an operator without its operand")
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[part]:
                out.append(stack.pop())
            stack.append(part)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("two operands")
            out.append(part)
            operand_next = False
    if operand_next or "(" in stack:
        raise ValueError("unfinished")
    return out + stack[::-1]


def whole_prefix(parts: list[str]) -> int:
    """How many parts the longest prefix that is an expression has, in one pass: after an operand or a
    closing parenthesis with none open, up to the first part that cannot follow."""
    whole = depth = 0
    operand_next = True
    for n, part in enumerate(parts, 1):
        if (part == "(" or part not in PRECEDENCE and part != ")") != operand_next:
            break
        if part == "(":
            depth += 1
            continue
        if part == ")":
            if not depth:
                break
            depth -= 1
        else:
            operand_next = part in PRECEDENCE
        if not depth and not operand_next:
            whole = n
    return whole


def evaluate(expression: str) -> Expression | None:
    """The longest prefix that is an expression; None if there is none."""
    parts = _PART.findall(expression.lower())
    end = whole_prefix(parts)
    if not end:
        return None
    stack: list[tuple[str, Expression]] = []
    for part in to_postfix(parts[:end]):
        if part not in PRECEDENCE:
            label = label_of(part)
            stack.append((part, Expression({label}, set(), label.split("-")[0] in PERMISSIVE and "-nc" not in label)))
            continue
        (name, right), (_, left) = stack.pop(), stack.pop()
        if part == "with":
            left.exceptions.add(name)
        else:
            # The larger sets take in the smaller ones, so that a long expression is not copied at each step.
            both, either = left.permissive and right.permissive, left.permissive or right.permissive
            left.labels, right.labels = sorted((left.labels, right.labels), key=len, reverse=True)
            left.exceptions, right.exceptions = sorted((left.exceptions, right.exceptions), key=len, reverse=True)
            left.labels |= right.labels
            left.exceptions |= right.exceptions
            left.permissive = both if part == "and" else either
        stack.append(("", left))
    return stack[0][1]


def automaton(phrases: dict[str, tuple]):
    """Over blank-joined words with a blank at either end, so that only whole words match."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 1, *value))
    machine.make_automaton()
    return machine


_machines: dict[str, object] = {}


def _machine():
    if "all" not in _machines:
        known = {p: ("notice", label) for p, label in NOTICE_PHRASES.items()}
        known |= {p: ("tag", "") for p in TAG_PHRASES}
        known |= {p: ("base", label) for p, label in BASE_PHRASES.items()}
        _machines["all"] = automaton(known)
    return _machines["all"]


def scan_text(raw: bytes | None) -> dict:
    """Places of phrases (kind, label, first word), the expressions' labels, and the digest."""
    words = raw.translate(ALNUM_TABLE).split() if raw else []
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    hits = [(end - length, kind, label) for end, (length, kind, label) in _machine().iter(joined)] if words else []
    places, at, word = [], 0, 0
    for start, kind, label in sorted(hits):
        word += joined.count(" ", at, start)
        at = start
        places.append((kind, label, word))
    base = [(label, w) for kind, label, w in places if kind == "base"]
    labels = {label for kind, label, _ in places if kind != "tag"}
    found = []
    if any(kind == "tag" for kind, _, _ in places):
        for match in _TAG.finditer(raw.lower()):
            value = evaluate(match[1].decode("utf-8", "replace"))
            if value:
                found.append(value)
                labels |= value.labels
    # One notice alone is weak evidence, a parsed tag strong; each further one halves the doubt.
    doubt = 1.0
    for kind, _, _ in places:
        doubt *= {"base": 0.5, "notice": 0.5, "tag": 1.0}[kind]
    doubt *= 0.1 ** len(found)
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((w for _, w in base), default=None),
        "last_word": max((w for _, w in base), default=None),
        "base_labels": ",".join(sorted({label for label, _ in base})),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 - doubt,
        "n_expressions": len(found),
        "permissive": all(x.permissive for x in found) if found else None,
    }


def scan_licences(docs: DataFrame) -> DataFrame:
    """A row of licence evidence for every row: word and base counts, base_labels, labels, score,
    and from tags the number of expressions and whether all can be met with permissive licences
    (null without one).

    A null text counts as empty: no words, no labels, score 0. Rows are scanned one by one, so
    repeated rows and null ids stay as they are; columns other than doc_id and text are ignored.
    """
    rows = columns_of(docs, "doc_id", "text")
    long, string = T.LongType(), T.StringType()
    kinds = {"n_words": long, "n_base": long, "first_word": long, "last_word": long, "base_labels": string,
             "labels": string, "score": T.DoubleType(), "n_expressions": long, "permissive": T.BooleanType()}
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, k) for n, k in kinds.items()]])

    def run(others: dict, texts: list[bytes | None]) -> dict:
        found = [scan_text(t) for t in texts]
        return {"doc_id": others["doc_id"]} | {n: [x[n] for x in found] for n in kinds}

    return map_bytes(rows, run, schema)
