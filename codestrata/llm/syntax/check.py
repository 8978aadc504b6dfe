"""Errors of a source text in the language that its path stands for."""

from __future__ import annotations

import sys

from codestrata.llm.syntax import c, ecma, go, java, json_, python_
from codestrata.llm.syntax.base import Bail, Lines

_PARSERS = {
    "Python": python_.parse,
    "JavaScript": lambda t, e: ecma.parse(t, e, False),
    "TypeScript": lambda t, e: ecma.parse(t, e, True),
    "Java": java.parse,
    "Go": go.parse,
    "C": c.parse,
    "JSON": json_.parse,
}
#: Languages whose texts are parsed.
LANGUAGES = tuple(_PARSERS)


def _normal(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


#: Python calls that one character of a text can nest at most; no grammar here has a longer chain of rules to a bracket.
CALLS = 64


def syntax_errors(text: str, language: str) -> list[tuple[int, str]]:
    """All errors as (line, what), in order; empty for a valid text. A language without a parser is never judged.

    The descent alone decides, in every language. Depth of nesting is never an error: the limit of recursion grows with the text, and
    calls between Python functions take no C stack.
    """
    parse = _PARSERS.get(language)
    if parse is None:
        return []
    t, errors = _normal(text), []
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(min(max(old, 12_000 + CALLS * len(t)), 2**31 - 1))
    try:
        parse(t, errors)
    except Bail:
        pass
    finally:
        sys.setrecursionlimit(old)
    lines = Lines(t)
    return sorted({(lines.of(p), w) for p, w in errors})
