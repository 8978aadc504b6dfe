"""Lexer for the brace languages."""

from __future__ import annotations

import re

from codestrata.llm.syntax.base import Tok

_NUM = {
    "js": r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+|n)?",
    "java": r"0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*\.?(?:[eE][+-]?\d+)?[lLfFdD]?",
    "c": r"0[xX][0-9a-fA-F]*(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?[uUlLfF]*|0[bB][01]+[uUlL]*|\d*\.\d+(?:[eE][+-]?\d+)?[fFlL]?|\d+\.?(?:[eE][+-]?\d+)?[uUlLfF]*",
    "go": r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?i?|\d[\d_]*\.?(?:[eE][+-]?\d+)?i?",
}
_OPS = {
    "js": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]",
    "java": r">>>=|\.\.\.|<<=|>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]",
    "c": r"\.\.\.|<<=|>>=|->|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[{}()\[\];,<>+\-*/%&|^!~?:=.]",
    "go": r"&\^=|<<=|>>=|\.\.\.|<-|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!~:=.]",
}
_STR = {
    "js": r'"(?:[^"\\\n]|\\(?:[^\n]|\n))*"|\'(?:[^\'\\\n]|\\(?:[^\n]|\n))*\'',
    "java": r'"""[ \t\f]*\n(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\[^\n])*"|\'(?:[^\'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n]))\'',
    "c": r'(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*"|[uUL]?\'(?:[^\'\\\n]|\\[^\n])+\'',
    "go": r'"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`|\'(?:[^\'\\\n]|\\(?:[abfnrtv\\\'"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))\'',
}
_ID = {"js": r"#?[^\W\d][\w$‌‍]*|#?\$[\w$]*", "java": r"[^\W\d][\w$]*|\$[\w$]*", "c": r"[^\W\d]\w*", "go": r"[^\W\d]\w*"}


def _compile(lang: str) -> re.Pattern:
    return re.compile(
        rf"(?P<ws>[ \t\f\v ﻿  ]+)|(?P<nl>\n)|(?P<cmt>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<str>{_STR[lang]})|(?P<id>{_ID[lang]})|(?P<num>(?:{_NUM[lang]}))|(?P<op>{_OPS[lang]})",
    )


_RE = {k: _compile(k) for k in _NUM}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
#: After these names a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of do else void delete instanceof new throw await yield".split())
_GO_ENDS_NAME_NOT = frozenset("break continue fallthrough return".split())
_GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def tokens(text: str, lang: str, errors: list, pos: int = 0, inner: bool = False):
    """Tokens from `pos` on; inside a template literal, up to the brace that closes the expression (returns its place as well)."""
    match, out, nl, depth, n = _RE[lang].match, [], True, 0, len(text)
    while pos < n:
        m = match(text, pos)
        if m is None:
            ch = text[pos]
            if lang == "js" and ch == "`":
                subs, end = _template(text, pos + 1, errors)
                out.append(Tok("tpl", "`", pos, nl, subs))
                pos, nl = end, False
                continue
            if text.startswith("/*", pos):
                errors.append((pos, "comment without end"))
                break
            errors.append((pos, "text without end" if ch in "\"'`" else f"no token: {ch!r}"))
            if ch in "\"'":
                e = text.find("\n", pos)
                end = n if e < 0 else e
                out.append(Tok("str", text[pos:end], pos, nl))
                pos, nl = end, False
            elif ch == "`":
                break
            else:
                pos += 1
            continue
        k, s = m.lastgroup, pos
        pos = m.end()
        if k == "ws":
            continue
        if k == "cmt":
            if "\n" in m[0]:
                if lang == "go":
                    _go_end(out, s, nl)
                nl = True
            continue
        if k == "nl":
            if lang == "go":
                _go_end(out, s, nl)
            nl = True
            continue
        t = m[0]
        if k == "op" and lang == "js":
            if t in ("/", "/="):
                p = out[-1] if out else None
                value = p is not None and (p.k in ("num", "str", "tpl", "rx") or p.k == "op" and p.t in (")", "]", "}", "++", "--") or p.k == "id" and p.t not in _BEFORE_REGEX)
                if not value and (r := _REGEX.match(text, s)):
                    out.append(Tok("rx", r[0], s, nl))
                    pos, nl = r.end(), False
                    continue
            elif inner and t == "{":
                depth += 1
            elif inner and t == "}":
                if depth == 0:
                    return out, pos
                depth -= 1
        if k == "num" and pos < n and (text[pos].isalpha() or text[pos] == "_"):
            errors.append((s, f"bad number {text[s : pos + 1]!r}"))
        out.append(Tok(k, t, s, nl))
        nl = False
    if lang == "go":
        _go_end(out, n, nl)
    if inner:
        errors.append((n, "template without end"))
        return out, n
    return out


def _go_end(out: list, pos: int, nl: bool) -> None:
    """The semicolon that a line end stands for."""
    if out and not (out[-1].k == "op" and out[-1].t == ";" and out[-1].sub):
        p = out[-1]
        if p.k in ("num", "str") or p.k == "op" and p.t in (")", "]", "}", "++", "--") or p.k == "id" and (p.t not in _GO_KEYWORDS or p.t in _GO_ENDS_NAME_NOT):
            out.append(Tok("op", ";", pos, False, True))


def _template(text: str, pos: int, errors: list):
    subs, n = [], len(text)
    while pos < n:
        c = text[pos]
        if c == "`":
            return subs, pos + 1
        if c == "\\":
            pos += 2
        elif c == "$" and text.startswith("${", pos):
            sub, pos = tokens(text, "js", errors, pos + 2, True)
            subs.append((sub, pos))
        else:
            pos += 1
    errors.append((n, "template without end"))
    return subs, n
