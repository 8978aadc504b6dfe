"""Which trigrams a regular expression cannot match without."""

from __future__ import annotations

import re
from re import _constants as C, _parser

#: Small classes are spelled out; beyond this many spellings a run of literals is cut.
MAX_SPELLINGS = 64
MAX_ALTERNATIVES = 400


def _items(op, arg) -> list[str] | None:
    """The single characters that an element can match, if they are few."""
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN:
        out = set()
        for o, a in arg:
            if o is C.LITERAL:
                out.add(chr(a).lower())
            elif o is C.RANGE and a[1] - a[0] < 12:
                out.update(chr(x).lower() for x in range(a[0], a[1] + 1))
            elif o is C.CATEGORY and a is C.CATEGORY_DIGIT:
                out.update("0123456789")
            else:
                return None
            if len(out) > 12:
                return None
        return sorted(out)
    return None


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _minimal(alts: set) -> set:
    """Alternatives that hold another one are implied by it."""
    ordered = sorted(alts, key=len)
    out: list = []
    for a in ordered:
        if not any(b <= a for b in out):
            out.append(a)
    return set(out)


def _both(a: set, b: set) -> set:
    out = {x | y for x in a for y in b}
    if len(out) > MAX_ALTERNATIVES:
        return a if min(map(len, a)) >= min(map(len, b)) else b
    return _minimal(out)


def _walk(seq) -> set:
    """Alternatives of trigram sets, one of which every match contains whole."""
    need: set = {frozenset()}
    runs = [""]

    def close():
        nonlocal need, runs
        if any(len(r) >= 3 for r in runs) and all(len(r) >= 3 for r in runs):
            need = _both(need, {_grams(r) for r in runs})
        runs = [""]

    for op, arg in seq:
        chars = _items(op, arg)
        if chars is not None:
            if len(runs) * len(chars) > MAX_SPELLINGS:
                tails = {r[-2:] for r in runs}
                close()
                runs = sorted(tails) if len(tails) * len(chars) <= MAX_SPELLINGS else [""]
            runs = [r + c for r in runs for c in chars]
        elif op is C.SUBPATTERN:
            sub = list(arg[3])
            if all(_items(o, a) is not None for o, a in sub):
                for o, a in sub:
                    cs = _items(o, a)
                    if len(runs) * len(cs) > MAX_SPELLINGS:
                        close()
                    runs = [r + c for r in runs for c in cs]
            else:
                close()
                need = _both(need, _walk(sub))
        elif op is C.BRANCH:
            plain = [[(o, a) for o, a in b] for b in arg[1]]
            if all(all(o is C.LITERAL for o, _ in b) for b in plain) and len(runs) * len(plain) <= MAX_SPELLINGS:
                words = ["".join(chr(a).lower() for _, a in b) for b in plain]
                runs = [r + w for r in runs for w in words]
            else:
                close()
                alts: set = set()
                for b in arg[1]:
                    alts |= _walk(b)
                need = _both(need, _minimal(alts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            sub = list(sub)
            if low >= 1 and len(sub) == 1 and (cs := _items(*sub[0])) is not None and low == high and len(runs) * len(cs) ** low <= MAX_SPELLINGS:
                for _ in range(low):
                    runs = [r + c for r in runs for c in cs]
            else:
                close()
                if low >= 1:
                    need = _both(need, _walk(sub))
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            close()
    close()
    return need


def required_trigrams(pattern: str, flags: int = 0) -> list[frozenset]:
    """Alternatives of lower-case trigram sets; a text that holds none of them whole cannot match.

    Raises ValueError for an expression that can match without any trigram, since no index helps it.
    """
    need = _minimal(_walk(_parser.parse(pattern, flags)))
    if frozenset() in need:
        raise ValueError(f"no required trigram: {pattern}")
    return sorted(need, key=sorted)
