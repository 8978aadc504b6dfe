"""C11. Names that no declaration of the text explains may be types, since undefined names are no error."""

from __future__ import annotations

import re

from codestrata.llm.syntax.base import EOF, Parser
from codestrata.llm.syntax.clex import tokens

_BASIC = frozenset("void char short int long float double signed unsigned _Bool _Complex bool".split())
_QUALIFIER = frozenset("const volatile restrict _Atomic static extern auto register inline typedef _Noreturn _Thread_local __inline __restrict __extension__".split())
_RESERVED = _BASIC - {"bool"} | _QUALIFIER | frozenset("break case continue default do else enum for goto if return sizeof struct switch union while _Alignas _Alignof _Generic _Static_assert".split())
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_DIRECTIVES = frozenset("define include undef if ifdef ifndef elif else endif line error pragma warning include_next elifdef elifndef ident".split())


class C(Parser):
    STARTERS = frozenset("if for while do switch return struct static const int char void typedef unsigned".split())
    BINARY = _BINARY

    def __init__(self, toks, end, errors):
        super().__init__(toks, end, errors)
        self.types = {"size_t", "ssize_t", "FILE", "va_list", "bool", "wchar_t", "ptrdiff_t", *(f"{u}int{n}_t" for u in ("", "u") for n in (8, 16, 32, 64, "ptr", "max"))}

    def whole(self) -> None:
        self.statements(self.external, None)

    def name(self) -> None:
        if self.cur.k != "id" or self.cur.t in _RESERVED:
            self.fail("expected a name")
        self.next()

    # -- declarations
    def external(self) -> None:
        if self.eat(";"):
            return None
        if self.at("_Static_assert"):
            return self.static_assert()
        start = self.i
        is_typedef, any_type = self.specifiers(True)
        if self.eat(";"):
            return None
        kind = self.declarator(is_typedef)
        if kind == "function" and self.at("{"):
            return self.block()
        if kind == "function" and self.cur.k == "id" and self.cur.t in _BASIC | {"struct", "const"}:
            while not self.at("{"):  # parameters declared after the list
                self.declaration()
            return self.block()
        if not any_type and self.i - start < 2:
            self.fail("expected a declaration")
        return self.declarators_rest(is_typedef)

    def static_assert(self) -> None:
        self.next()
        self.need("(")
        self.conditional()
        if self.eat(","):
            self.next()
        self.need(")")
        self.need(";")

    def attributes(self) -> None:
        while self.at("__attribute__", "_Alignas", "__declspec", "__asm__", "asm"):
            self.next()
            if self.at("(") and self.i in self.partner:
                self.seek(self.partner[self.i])
                self.next()
            else:
                self.fail("expected '('")

    def specifiers(self, declaring: bool) -> tuple[bool, bool]:
        is_typedef = seen = False
        while True:
            self.attributes()
            t = self.cur
            if t.k != "id":
                break
            if t.t in _QUALIFIER:
                is_typedef |= t.t == "typedef"
                self.next()
            elif t.t in _BASIC:
                seen = True
                self.next()
            elif t.t in ("struct", "union", "enum"):
                seen = True
                self.next()
                self.attributes()
                named = self.cur.k == "id"
                if named:
                    self.name()
                if self.at("{"):
                    self.enum_body() if t.t == "enum" else self.struct_body()
                elif not named:
                    self.fail("expected a name")
            elif not seen and t.t not in _RESERVED:
                n = self.ahead()
                if t.t in self.types or n.k == "id" and n.t not in ("sizeof",) or n.k == "op" and n.t == "*" or not declaring:
                    seen = True
                    self.next()
                else:
                    break
            else:
                break
        if declaring and not seen and not (self.cur.k == "id" and self.ahead().t == "(" and self.cur.t not in _RESERVED):
            self.fail("expected a type")
        return is_typedef, seen

    def struct_body(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.at("_Static_assert"):
                self.static_assert()
                continue
            self.specifiers(True)
            if not self.at(";"):
                while True:
                    if not self.at(":"):
                        self.declarator(False)
                    if self.eat(":"):
                        self.conditional()
                    self.attributes()
                    if not self.eat(","):
                        break
            self.need(";")
        self.need("}")

    def enum_body(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.name()
            if self.eat("="):
                self.conditional()
            if not self.at("}"):
                self.need(",")
        self.need("}")

    def pointer(self) -> None:
        while self.at("*", "^"):
            self.next()
            while self.cur.t in _QUALIFIER and self.cur.k == "id":
                self.next()
            self.attributes()

    def declarator(self, is_typedef: bool, abstract: bool = False) -> str:
        self.nest()
        self.pointer()
        kind = "object"
        if self.at("(") and not (abstract and (self.ahead().t in (")", "void") or self.type_at(1))):
            self.next()
            self.declarator(is_typedef, abstract)
            self.need(")")
        elif self.cur.k == "id" and self.cur.t not in _RESERVED:
            if is_typedef:
                self.types.add(self.cur.t)
            self.next()
        elif not abstract:
            self.fail("expected a name")
        while True:
            if self.eat("["):
                while self.cur.t in _QUALIFIER and self.cur.k == "id":
                    self.next()
                if not self.at("]"):
                    if self.at("*") and self.ahead().t == "]":
                        self.next()
                    else:
                        self.assignment()
                self.need("]")
            elif self.at("("):
                self.parameters()
                kind = "function"
            else:
                break
        self.attributes()
        self.depth -= 1
        return kind

    def parameters(self) -> None:
        self.need("(")
        while not self.at(")"):
            if self.eat("..."):
                break
            if self.cur.k == "id" and self.ahead().t in (",", ")") and self.cur.t not in _RESERVED:
                self.next()
            else:
                self.specifiers(True)
                self.declarator(False, True)
            if not self.at(")"):
                self.need(",")
                if self.at(")"):
                    self.fail("expected a parameter")
        self.need(")")

    def declarators_rest(self, is_typedef: bool) -> None:
        while True:
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                break
            self.declarator(is_typedef)
        self.need(";")

    def declaration(self) -> None:
        is_typedef, _ = self.specifiers(True)
        if self.eat(";"):
            return
        self.declarator(is_typedef)
        self.declarators_rest(is_typedef)

    def initializer(self) -> None:
        if not self.at("{"):
            self.assignment()
            return
        self.nest()
        self.next()
        while not self.at("}"):
            named = False
            while self.at("[", "."):
                named = True
                if self.next().t == ".":
                    self.name()
                else:
                    self.conditional()
                    if self.eat("..."):
                        self.conditional()
                    self.need("]")
            if named:
                self.need("=")
            self.initializer()
            if not self.at("}"):
                self.need(",")
        self.need("}")
        self.depth -= 1

    # -- statements
    def block(self) -> None:
        self.need("{")
        self.statements(self.statement, "}")
        self.need("}")

    def type_at(self, n: int = 0) -> bool:
        t = self.ahead(n) if n else self.cur
        return t.k == "id" and (t.t in _BASIC or t.t in _QUALIFIER or t.t in self.types or t.t in ("struct", "union", "enum", "_Alignas"))

    def declaration_follows(self) -> bool:
        if self.type_at():
            return True
        t, n = self.cur, self.ahead()
        if t.k != "id" or t.t in _RESERVED:
            return False
        if n.k == "id" and n.t not in _RESERVED:
            return True
        if n.t == "*" and n.k == "op":
            k = 1
            while self.ahead(k).t in ("*", "const"):
                k += 1
            return self.ahead(k).k == "id" and self.ahead(k + 1).t in ("=", ";", ",", "[") and self.ahead(k + 1).t != ","
        return False

    def statement(self) -> None:
        t = self.cur
        if t.k == "op":
            if t.t == "{":
                return self.block()
            if self.eat(";"):
                return None
        elif t.k == "id":
            f = getattr(self, "st_" + t.t, None) if t.t in _RESERVED else None
            if f:
                return f()
            if t.t == "_Static_assert":
                return self.static_assert()
            if self.ahead().t == ":" and t.t not in _RESERVED:
                self.next()
                self.next()
                return self.statement() if not self.at("}") else None
            if self.declaration_follows():
                return self.declaration()
        self.expression()
        self.need(";")
        return None

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def st_if(self) -> None:
        self.next()
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def st_while(self) -> None:
        self.next()
        self.paren()
        self.statement()

    st_switch = st_while

    def st_do(self) -> None:
        self.next()
        self.statement()
        self.need("while")
        self.paren()
        self.need(";")

    def st_for(self) -> None:
        self.next()
        self.need("(")
        if self.declaration_follows():
            self.declaration()
        else:
            if not self.at(";"):
                self.expression()
            self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.statement()

    def st_case(self) -> None:
        self.next()
        self.conditional()
        if self.eat("..."):
            self.conditional()
        self.need(":")
        if not self.at("}"):
            self.statement()

    def st_default(self) -> None:
        self.next()
        self.need(":")
        if not self.at("}"):
            self.statement()

    def st_return(self) -> None:
        self.next()
        if not self.at(";"):
            self.expression()
        self.need(";")

    def st_break(self) -> None:
        self.next()
        self.need(";")

    st_continue = st_break

    def st_goto(self) -> None:
        self.next()
        self.name()
        self.need(";")

    # -- expressions
    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def assignment(self) -> None:
        self.nest()
        node = self.conditional()
        if self.cur.k == "op" and self.cur.t in _ASSIGN:
            if node == "value":
                self.fail("no target of an assignment")
            self.next()
            self.assignment()
        self.depth -= 1

    def conditional(self) -> str:
        node = self.binary()
        if self.eat("?"):
            if not self.at(":"):
                self.expression()
            self.need(":")
            self.conditional()
            return "value"
        return node

    def type_name(self) -> None:
        self.specifiers(False)
        self.declarator(False, True)

    def closed_type(self) -> None:
        self.need("(")
        if not self.type_at() and not (self.cur.k == "id" and self.cur.t not in _RESERVED and self.ahead().t in (")", "*")):
            self.fail("no type")
        self.type_name()
        self.need(")")

    def unary(self) -> str:
        self.nest()
        node = self.unary_()
        self.depth -= 1
        return node

    def unary_(self) -> str:
        t = self.cur
        if t.k == "op":
            if t.t in ("++", "--", "+", "-", "!", "~", "&", "&&"):
                self.next()
                self.unary()
                return "value"
            if t.t == "*":
                self.next()
                self.unary()
                return "target"
            if t.t == "(":
                known = self.type_at(1)
                j = self.partner.get(self.i)
                n = self.toks[j + 1] if j is not None else None
                maybe = n is not None and (n.k in ("id", "num", "str") or n.t == "{")
                if (known or maybe) and self.quiet(self.closed_type):
                    if self.at("{"):
                        self.initializer()
                        return self.subscripts("target")
                    self.unary()
                    return "value"
        elif t.k == "id" and t.t in ("sizeof", "_Alignof"):
            self.next()
            if not (self.at("(") and self.type_at(1) and self.quiet(self.closed_type)):
                self.unary()
            return "value"
        return self.subscripts(self.primary())

    def subscripts(self, node: str) -> str:
        while self.cur.k == "op":
            t = self.cur.t
            if t == "[":
                self.next()
                self.expression()
                self.need("]")
                node = "target"
            elif t == "(":
                self.next()
                while not self.at(")"):
                    if self.type_at():
                        self.type_name()
                    else:
                        self.assignment()
                    if not self.at(")"):
                        self.need(",")
                        if self.at(")"):
                            self.fail("expected a value")
                self.need(")")
                node = "value"
            elif t in (".", "->"):
                self.next()
                self.name()
                node = "target"
            elif t in ("++", "--"):
                self.next()
                node = "value"
            else:
                break
        return node

    def primary(self) -> str:
        t = self.cur
        if t.k == "num":
            self.next()
            return "value"
        if t.k == "str":
            while self.cur.k == "str" or self.cur.k == "id" and self.cur.t.startswith("PRI"):
                self.next()
            return "value"
        if t.k == "id" and t.t == "_Generic":
            self.next()
            self.need("(")
            self.assignment()
            while self.eat(","):
                if not self.eat("default"):
                    self.type_name()
                self.need(":")
                self.assignment()
            self.need(")")
            return "value"
        if t.k == "id" and t.t not in _RESERVED:
            self.next()
            return "target"
        if t.k == "op" and t.t == "(":
            self.next()
            if self.at("{"):
                self.block()
            else:
                self.expression()
            self.need(")")
            return "target"
        self.fail("expected a value")


_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*([A-Za-z_]*)((?:[^\n\\]|\\\n|\\.)*)", re.M)
_COMMENT = re.compile(r'/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')


def preprocess(text: str, errors: list) -> str:
    """Blanks directives, keeping places; of alternatives only the first branch stays, as only one is ever compiled."""
    plain = _COMMENT.sub(lambda m: m[0] if m[0][0] in "\"'" else re.sub(r"[^\n]", " ", m[0]), text)
    out, stack, last = [], [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    for m in _DIRECTIVE.finditer(plain):
        body = plain[last : m.start()]
        out.append(blank(body) if any(x != "take" for x in stack) else body)
        out.append(blank(m[0]))
        last = m.end()
        word, rest = m[1], m[2].strip()
        if word in ("if", "ifdef", "ifndef"):
            if not rest:
                errors.append((m.start(), f"#{word} without a condition"))
            stack.append("skip" if word == "if" and rest == "0" else "take")
        elif word in ("elif", "else", "elifdef", "elifndef"):
            if not stack:
                errors.append((m.start(), f"#{word} without #if"))
            else:
                stack[-1] = {"skip": "take", "take": "done"}.get(stack[-1], "done")
        elif word == "endif":
            if not stack:
                errors.append((m.start(), "#endif without #if"))
            else:
                stack.pop()
        elif word == "include":
            if not re.match(r'<[^>\n]+>|"[^"\n]+"|[A-Za-z_]\w*', rest):
                errors.append((m.start(), "bad #include"))
        elif word == "define":
            if not re.match(r"[A-Za-z_]\w*(\([^()\n]*\))?", rest):
                errors.append((m.start(), "bad #define"))
        elif (word or rest) and word not in _DIRECTIVES and not (not word and rest[:1].isdigit()) and not any(x != "take" for x in stack):
            errors.append((m.start(), f"no directive: #{word or rest[:20]}"))
    body = plain[last:]
    out.append(blank(body) if any(x != "take" for x in stack) else body)
    if stack:
        errors.append((len(text), "#if without #endif"))
    return "".join(out)


def parse(text: str, errors: list) -> None:
    plain = preprocess(text, errors)
    C(tokens(plain, "c", errors), len(text), errors).whole()
