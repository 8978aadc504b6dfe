"""Python 3."""

from __future__ import annotations

import re

from codestrata.llm.syntax.base import EOF, Bail, Parser, Tok

_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
_COMPARE = frozenset("== != < > <= >= in is not".split())
_ASSIGN = frozenset("= += -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_STRING = re.compile(
    r"""(?:[rbufRBUFtT]{0,3})(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*")"""
)
_NUMBER = re.compile(r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?")
_OP = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|<=|>=|:=|<<|>>|\*\*|//|[-+*/%@&|^~<>()\[\]{},:.;=!]")
_NAME = re.compile(r"[^\W\d]\w*")
_PREFIX = re.compile(r"[rbufRBUFtT]{1,3}(?=['\"])")


def lex(text: str, errors: list) -> list[Tok]:
    out, indents, nest, pos, n, line_start = [], [0], 0, 0, len(text), True
    while pos < n:
        if line_start and nest == 0:
            start = pos
            while pos < n and text[pos] in " \t\f":
                pos += 1
            if pos >= n:
                break
            if text[pos] in "#\n":
                while pos < n and text[pos] != "\n":
                    pos += 1
                pos += 1
                continue
            width = len(text[start:pos].replace("\f", "").expandtabs(8))
            if width > indents[-1]:
                indents.append(width)
                out.append(Tok("indent", "", pos))
            else:
                while width < indents[-1]:
                    indents.pop()
                    out.append(Tok("dedent", "", pos))
                if width != indents[-1]:
                    errors.append((pos, "unindent to no outer level"))
            line_start = False
        c = text[pos]
        if c in " \t\f":
            pos += 1
        elif c == "\n":
            if nest == 0:
                out.append(Tok("newline", "", pos))
                line_start = True
            pos += 1
        elif c == "#":
            while pos < n and text[pos] != "\n":
                pos += 1
        elif c == "\\" and text.startswith("\\\n", pos):
            pos += 2
        elif c in "\"'" or _PREFIX.match(text, pos):
            m = _STRING.match(text, pos)
            if m is None:
                errors.append((pos, "text without end"))
                e = text.find("\n", pos)
                pos = n if e < 0 or text.startswith(('"""', "'''"), pos) else e
                out.append(Tok("str", "?", pos))
            else:
                out.append(Tok("str", m[0], pos))
                pos = m.end()
        elif (m := _NAME.match(text, pos)):
            out.append(Tok("id", m[0], pos))
            pos = m.end()
        elif c.isdigit() or c == "." and pos + 1 < n and text[pos + 1].isdigit():
            m = _NUMBER.match(text, pos)
            out.append(Tok("num", m[0], pos))
            pos = m.end()
            w = _NAME.match(text, pos)
            if w and w[0] not in ("and", "or", "if", "else", "in", "is", "for", "not"):
                errors.append((pos, "bad number"))
            if len(m[0]) > 1 and m[0][0] == "0" and m[0].isdigit() and m[0].strip("0"):
                errors.append((pos, "leading zeros"))
        elif (m := _OP.match(text, pos)):
            t = m[0]
            nest = nest + 1 if t in "([{" else max(0, nest - 1) if t in ")]}" else nest
            out.append(Tok("op", t, pos))
            pos = m.end()
        else:
            errors.append((pos, f"no token: {c!r}"))
            pos += 1
    if out and out[-1].k not in ("newline",):
        out.append(Tok("newline", "", n))
    out.extend(Tok("dedent", "", n) for _ in indents[1:])
    return out


class Python(Parser):
    BINARY = _BINARY

    def whole(self) -> None:
        while self.cur.k != EOF:
            self.guarded(self.statement)

    def guarded(self, one) -> None:
        """One statement; after an error, the rest of its line and of its block is skipped."""
        start = self.i
        try:
            one()
        except Bail:
            pass
        else:
            if self.i > start:
                return
            self.errors.append((self.cur.p, "unexpected indent" if self.cur.k == "indent" else "unexpected text"))
        self.depth = 0
        if self.i == start:
            self.next()
        while self.cur.k not in ("newline", EOF, "dedent"):
            self.next()
        if self.cur.k == "newline":
            self.next()
        if self.cur.k == "indent":
            level = 0
            while self.cur.k != EOF:
                level += {"indent": 1, "dedent": -1}.get(self.next().k, 0)
                if level == 0:
                    break

    def name(self) -> None:
        if self.cur.k != "id" or self.cur.t in _KEYWORDS:
            self.fail("expected a name")
        self.next()

    def newline(self) -> None:
        if self.cur.k != "newline":
            self.fail("expected the end of the line")
        self.next()

    def block(self) -> None:
        self.need(":")
        if self.cur.k != "newline":
            return self.simple_line()
        self.next()
        if self.cur.k != "indent":
            self.fail("expected an indented block")
        self.next()
        while self.cur.k not in ("dedent", EOF):
            self.guarded(self.statement)
        if self.cur.k == "dedent":
            self.next()
        return None

    def statement(self) -> None:
        t = self.cur
        if t.k == "id":
            f = getattr(self, "st_" + t.t, None)
            if f and t.t in _KEYWORDS:
                return f()
            if t.t == "match" and (self.ahead().k in ("id", "num", "str") or self.ahead().t in ("(", "[", "{", "-", "*")) and self.quiet(self.match_head):
                return self.match_body()
        elif t.k == "op" and t.t == "@":
            while self.eat("@"):
                self.named()
                self.newline()
            if not self.at("def", "class", "async"):
                self.fail("expected 'def' or 'class'")
            return self.statement()
        elif t.k in ("indent", "dedent"):
            if t.k == "dedent":
                self.next()
                return None
            self.fail("unexpected indent")
        return self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.eat(";") or self.cur.k == "newline":
                break
        self.newline()

    def simple(self) -> None:
        t = self.cur
        w = t.t if t.k == "id" else ""
        if w in ("pass", "break", "continue"):
            self.next()
        elif w == "return":
            self.next()
            if not self.at(";") and self.cur.k != "newline":
                self.stars()
        elif w == "raise":
            self.next()
            if not self.at(";") and self.cur.k != "newline":
                self.test()
                if self.eat("from"):
                    self.test()
        elif w in ("global", "nonlocal"):
            self.next()
            self.name()
            while self.eat(","):
                self.name()
        elif w == "del":
            self.next()
            self.stars()
        elif w == "assert":
            self.next()
            self.test()
            if self.eat(","):
                self.test()
        elif w == "import":
            self.next()
            while True:
                self.dotted()
                if self.eat("as"):
                    self.name()
                if not self.eat(","):
                    break
        elif w == "from":
            self.next()
            dots = False
            while self.at(".", "..."):
                dots = True
                self.next()
            if not (dots and self.at("import")):
                self.dotted()
            self.need("import")
            if self.eat("*"):
                return
            closed = self.eat("(")
            while True:
                self.name()
                if self.eat("as"):
                    self.name()
                if not self.eat(",") or closed and self.at(")"):
                    break
            if closed:
                self.need(")")
        elif w == "type" and self.ahead().k == "id" and self.ahead().t not in _KEYWORDS:
            self.next()
            self.name()
            if self.at("["):
                self.type_params()
            self.need("=")
            self.test()
        else:
            node = self.stars()
            if self.at(":"):
                self.next()
                self.test()
                if self.eat("="):
                    self.stars()
                return
            first = True
            while self.cur.k == "op" and self.cur.t in _ASSIGN:
                op = self.next().t
                if node == "value" or op != "=" and (node == "list" or not first):
                    self.fail("no target of an assignment")
                node = self.stars()
                first = False
                if op != "=":
                    break

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    # -- compound statements
    def st_if(self) -> None:
        self.next()
        self.named()
        self.block()
        while self.at("elif"):
            self.next()
            self.named()
            self.block()
        if self.eat("else"):
            self.block()

    def st_while(self) -> None:
        self.next()
        self.named()
        self.block()
        if self.eat("else"):
            self.block()

    def st_for(self) -> None:
        self.next()
        self.targets()
        self.need("in")
        self.stars()
        self.block()
        if self.eat("else"):
            self.block()

    def st_try(self) -> None:
        self.next()
        self.block()
        caught = False
        while self.at("except"):
            caught = True
            self.next()
            self.eat("*")
            if not self.at(":"):
                self.test()
                if self.eat("as"):
                    self.name()
            self.block()
        if caught and self.eat("else"):
            self.block()
        if self.eat("finally"):
            self.block()
        elif not caught:
            self.fail("expected 'except' or 'finally'")

    def st_with(self) -> None:
        self.next()
        if not (self.at("(") and self.quiet(self.with_closed)):
            self.with_items()
        self.block()

    def with_closed(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.with_item()
            if not self.at(")"):
                self.need(",")
        self.need(")")
        if not self.at(":"):
            self.fail("expected ':'")

    def with_items(self) -> None:
        self.with_item()
        while self.eat(","):
            self.with_item()

    def with_item(self) -> None:
        self.test()
        if self.eat("as"):
            self.target()

    def st_async(self) -> None:
        self.next()
        if not self.at("def", "for", "with"):
            self.fail("expected 'def', 'for' or 'with'")
        self.statement()

    def st_def(self) -> None:
        self.next()
        self.name()
        if self.at("["):
            self.type_params()
        self.need("(")
        self.params(")", True)
        self.need(")")
        if self.eat("->"):
            self.stars()
        self.block()

    def st_class(self) -> None:
        self.next()
        self.name()
        if self.at("["):
            self.type_params()
        if self.at("("):
            self.arguments()
        self.block()

    def st_else(self) -> None:
        self.fail("unexpected word")

    st_elif = st_except = st_finally = st_else

    def type_params(self) -> None:
        self.need("[")
        while not self.at("]"):
            self.eat("*") or self.eat("**")
            self.name()
            if self.eat(":"):
                self.test()
            if self.eat("="):
                self.test()
            if not self.at("]"):
                self.need(",")
        self.need("]")

    def params(self, end: str, typed: bool) -> None:
        default = star = False
        while not self.at(end):
            if self.eat("**"):
                self.name()
                if typed and self.eat(":"):
                    self.test()
            elif self.eat("*"):
                star = True
                if not self.at(","):
                    self.name()
                    if typed and self.eat(":"):
                        self.or_star()
            elif self.eat("/"):
                pass
            else:
                self.name()
                if typed and self.eat(":"):
                    self.test()
                if self.eat("="):
                    default = True
                    self.test()
                elif default and not star:
                    self.fail("parameter without default follows one with default")
            if not self.at(end):
                self.need(",")

    def match_head(self) -> None:
        self.next()
        self.stars()
        self.need(":")
        self.newline()
        if self.cur.k != "indent" or not (self.ahead().t == "case" and self.ahead().k == "id"):
            self.fail("expected cases")
        self.next()

    def match_body(self) -> None:
        while self.at("case"):
            self.next()
            self.patterns()
            if self.eat("if"):
                self.named()
            self.block()
        if self.cur.k != "dedent":
            self.fail("expected 'case'")
        self.next()

    def patterns(self) -> None:
        self.pattern()
        while self.eat(","):
            if self.at(":", "if"):
                return
            self.pattern()

    def pattern(self) -> None:
        self.nest()
        while True:
            if self.eat("*"):
                self.name()
            elif self.at("(", "["):
                end = {"(": ")", "[": "]"}[self.next().t]
                while not self.at(end):
                    self.pattern()
                    if not self.at(end):
                        self.need(",")
                self.need(end)
            elif self.eat("{"):
                while not self.at("}"):
                    if self.eat("**"):
                        self.name()
                    else:
                        self.binary()
                        self.need(":")
                        self.pattern()
                    if not self.at("}"):
                        self.need(",")
                self.need("}")
            elif self.cur.k == "id" and self.cur.t not in _KEYWORDS:
                self.dotted()
                if self.eat("("):
                    while not self.at(")"):
                        if self.cur.k == "id" and self.ahead().t == "=":
                            self.next()
                            self.next()
                        self.pattern()
                        if not self.at(")"):
                            self.need(",")
                    self.need(")")
            else:
                self.binary()
            if not self.eat("|"):
                break
        if self.eat("as"):
            self.name()
        self.depth -= 1

    # -- expressions
    def ends(self) -> bool:
        return self.cur.k in ("newline", EOF) or self.cur.k == "op" and (self.cur.t in (")", "]", "}", ":", ";") or self.cur.t in _ASSIGN)

    def stars(self) -> str:
        node = self.or_star()
        if self.at(","):
            node = "list" if node != "value" else "value"
            while self.eat(","):
                if self.ends():
                    break
                if self.or_star() == "value":
                    node = "value"
        return node

    def or_star(self) -> str:
        if self.eat("*"):
            self.binary()
            return "list"
        return self.named()

    def named(self) -> str:
        node = self.test()
        if self.at(":=") and node == "name":
            self.next()
            self.test()
            return "value"
        return node

    def targets(self) -> None:
        self.target()
        while self.eat(","):
            if self.at("in"):
                return
            self.target()

    def target(self) -> None:
        self.eat("*")
        if self.power() == "value":
            self.fail("no target")

    def test(self) -> str:
        self.nest()
        if self.at("lambda"):
            self.next()
            self.params(":", False)
            self.need(":")
            self.test()
            node = "value"
        elif self.at("yield"):
            self.next()
            if self.eat("from"):
                self.test()
            elif not self.ends():
                self.stars()
            node = "value"
        else:
            node = self.or_()
            if self.at("if"):
                self.next()
                self.or_()
                self.need("else")
                self.test()
                node = "value"
        self.depth -= 1
        return node

    def or_(self) -> str:
        node = self.and_()
        while self.at("or"):
            self.next()
            self.and_()
            node = "value"
        return node

    def and_(self) -> str:
        node = self.not_()
        while self.at("and"):
            self.next()
            self.not_()
            node = "value"
        return node

    def not_(self) -> str:
        if self.at("not"):
            self.next()
            self.nest()
            self.not_()
            self.depth -= 1
            return "value"
        node = self.binary()
        while self.cur.t in _COMPARE and self.cur.k in ("op", "id"):
            t = self.next().t
            if t == "not":
                self.need("in")
            elif t == "is":
                self.eat("not")
            self.binary()
            node = "value"
        return node

    def unary(self) -> str:
        if self.at("+", "-", "~"):
            self.next()
            self.nest()
            self.unary()
            self.depth -= 1
            return "value"
        return self.power()

    def power(self) -> str:
        if self.at("await"):
            self.next()
            self.subscripts(self.atom())
            node = "value"
        else:
            node = self.subscripts(self.atom())
        if self.at("**"):
            self.next()
            self.unary()
            node = "value"
        return node

    def subscripts(self, node: str) -> str:
        while self.cur.k == "op":
            if self.at("."):
                self.next()
                self.name()
                node = "target"
            elif self.at("("):
                self.arguments()
                node = "value"
            elif self.at("["):
                self.next()
                while True:
                    self.slice()
                    if not self.eat(",") or self.at("]"):
                        break
                self.need("]")
                node = "target"
            else:
                break
        return node

    def slice(self) -> None:
        if not self.at(":"):
            self.or_star()
        for _ in range(2):
            if self.eat(":") and not self.at(":", ",", "]"):
                self.test()

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            if self.eat("**") or self.eat("*"):
                self.test()
            elif self.cur.k == "id" and self.cur.t not in _KEYWORDS and self.ahead().t == "=" and self.ahead().k == "op":
                self.next()
                self.next()
                self.test()
            else:
                self.named()
                if self.at("for", "async"):
                    self.comprehension()
            if not self.at(")"):
                self.need(",")
        self.need(")")

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.eat("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.or_()
            while self.at("if"):
                self.next()
                node = self.or_()
                if self.at(":=") and node == "name":
                    self.next()
                    self.or_()

    def atom(self) -> str:
        t = self.cur
        if t.k == "id":
            if t.t in ("None", "True", "False"):
                self.next()
                return "value"
            if t.t in _KEYWORDS:
                self.fail("unexpected word")
            self.next()
            return "name"
        if t.k == "num":
            self.next()
            return "value"
        if t.k == "str":
            while self.cur.k == "str":
                self.next()
            return "value"
        if t.k == "op":
            if t.t == "...":
                self.next()
                return "value"
            if t.t == "(":
                self.next()
                if self.eat(")"):
                    return "list"
                node = self.or_star()
                if self.at("for", "async"):
                    self.comprehension()
                    node = "value"
                else:
                    while self.eat(","):
                        if self.at(")"):
                            break
                        node = "value" if "value" in (self.or_star(), node) else "list"
                self.need(")")
                return node
            if t.t == "[":
                self.next()
                node = "list"
                if not self.at("]"):
                    node = "value" if self.or_star() == "value" else "list"
                    if self.at("for", "async"):
                        self.comprehension()
                        node = "value"
                    while self.eat(","):
                        if self.at("]"):
                            break
                        node = "value" if "value" in (self.or_star(), node) else "list"
                self.need("]")
                return node
            if t.t == "{":
                self.next()
                while not self.at("}"):
                    if self.eat("**"):
                        self.binary()
                    else:
                        self.or_star()
                        if self.eat(":"):
                            self.test()
                    if self.at("for", "async"):
                        self.comprehension()
                    if not self.at("}"):
                        self.need(",")
                self.need("}")
                return "value"
        self.fail("expected a value")


def parse(text: str, errors: list) -> None:
    Python(lex(text, errors), len(text), errors).whole()
