"""Go."""

from __future__ import annotations

from codestrata.llm.syntax.base import EOF, Parser
from codestrata.llm.syntax.clex import tokens

_RESERVED = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class Go(Parser):
    STARTERS = frozenset("func type var const import if for switch select return go defer".split())
    BINARY = _BINARY

    def __init__(self, toks, end, errors):
        super().__init__(toks, end, errors)
        self.control = False

    def whole(self) -> None:
        if not self.at("package"):
            self.errors.append((self.cur.p, "expected 'package'"))
        else:
            self.next()
            if self.cur.k == "id" and self.cur.t not in _RESERVED:
                self.next()
                if not self.eat(";"):
                    self.errors.append((self.cur.p, "expected ';'"))
            else:
                self.errors.append((self.cur.p, "expected a name"))
        self.imports = True
        self.statements(self.top, None)

    def name(self) -> None:
        if self.cur.k != "id" or self.cur.t in _RESERVED:
            self.fail("expected a name")
        self.next()

    def end(self) -> None:
        if not (self.eat(";") or self.at("}", ")") or self.cur.k == EOF):
            self.fail("expected a line end")

    def top(self) -> None:
        if self.eat(";"):
            return None
        if self.at("import"):
            if not self.imports:
                self.errors.append((self.cur.p, "import after a declaration"))
            self.next()
            self.group(self.import_)
            return self.end()
        self.imports = False
        if self.at("func"):
            self.next()
            if self.at("("):
                self.params()
            self.name()
            if self.at("["):
                self.type_params()
            self.signature()
            if self.at("{"):
                self.block()
            return self.end()
        if self.at("var", "const", "type"):
            self.declaration()
            return self.end()
        self.fail("expected a declaration")

    def import_(self) -> None:
        if self.at("."):
            self.next()
        elif self.cur.k == "id":
            self.name()
        if self.cur.k != "str" or self.cur.t[0] == "'":
            self.fail("expected a path")
        self.next()

    def group(self, one) -> None:
        if self.eat("("):
            while not self.at(")"):
                one()
                if not self.at(")"):
                    self.need(";")
            self.need(")")
        else:
            one()

    def declaration(self) -> None:
        self.group({"var": self.var, "const": self.const, "type": self.type_spec}[self.next().t])

    def names(self) -> None:
        self.name()
        while self.eat(","):
            self.name()

    def var(self) -> None:
        self.names()
        if self.eat("="):
            return self.expressions()
        self.type_()
        if self.eat("="):
            self.expressions()
        return None

    def const(self) -> None:
        self.names()
        if self.at("=", ";", ")"):
            if self.eat("="):
                self.expressions()
            return
        self.type_()
        self.need("=")
        self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.quiet(self.type_params):
            pass
        self.eat("=")
        self.type_()

    def type_params(self) -> None:
        self.need("[")
        while not self.at("]"):
            self.names()
            self.constraint()
            if not self.at("]"):
                self.need(",")
        self.need("]")

    def constraint(self) -> None:
        while True:
            if self.at("~"):
                self.next()
            self.type_()
            if not self.eat("|"):
                return

    # -- types
    def type_(self) -> None:
        if not self.try_type():
            self.fail("expected a type")

    def try_type(self) -> bool:
        self.nest()
        t, ok = self.cur, True
        if t.k == "id":
            if t.t == "struct":
                self.struct()
            elif t.t == "interface":
                self.interface()
            elif t.t == "map":
                self.next()
                self.need("[")
                self.type_()
                self.need("]")
                self.type_()
            elif t.t == "chan":
                self.next()
                if self.at("<-"):
                    self.next()
                self.type_()
            elif t.t == "func":
                self.next()
                self.signature()
            elif t.t in _RESERVED:
                ok = False
            else:
                self.type_name()
        elif t.k == "op" and t.t == "*":
            self.next()
            self.type_()
        elif t.k == "op" and t.t == "(":
            self.next()
            self.type_()
            self.need(")")
        elif t.k == "op" and t.t == "<-":
            self.next()
            self.need("chan")
            self.type_()
        elif t.k == "op" and t.t == "[":
            self.next()
            if self.at("..."):
                self.next()
            elif not self.at("]"):
                old, self.control = self.control, False
                self.expression()
                self.control = old
            self.need("]")
            self.type_()
        else:
            ok = False
        self.depth -= 1
        return ok

    def type_name(self) -> None:
        self.name()
        if self.at("."):
            self.next()
            self.name()
        if self.at("[") and self.ahead().t != "]":
            self.quiet(self.type_args)

    def type_args(self) -> None:
        self.need("[")
        while not self.at("]"):
            self.type_()
            if not self.at("]"):
                self.need(",")
        self.need("]")

    def struct(self) -> None:
        self.next()
        self.need("{")
        while not self.at("}"):
            if self.at("*"):
                self.type_()
            elif self.cur.k == "id" and (self.ahead().t in (".", ";", "}") and self.ahead().k == "op" or self.ahead().k == "str"):
                self.type_name()
            else:
                self.names()
                self.type_()
            if self.cur.k == "str":
                self.next()
            if not self.at("}"):
                self.need(";")
        self.need("}")

    def interface(self) -> None:
        self.next()
        self.need("{")
        while not self.at("}"):
            if self.cur.k == "id" and self.ahead().t == "(" and self.cur.t not in _RESERVED:
                self.next()
                self.signature()
            else:
                self.constraint()
            if not self.at("}"):
                self.need(";")
        self.need("}")

    def signature(self) -> None:
        self.params()
        if self.at("("):
            self.params()
        else:
            self.try_type()

    def params(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.param()
            if not self.at(")"):
                self.need(",")
        self.need(")")

    def param(self) -> None:
        if self.at("..."):
            self.next()
            return self.type_()
        if self.cur.k == "id" and self.cur.t not in _RESERVED:
            n = self.ahead()
            if n.k == "id" or n.k == "op" and n.t in ("*", "[", "...", "(", "<-"):
                self.next()
                if self.at("..."):
                    self.next()
                return self.type_()
        return self.type_()

    # -- statements
    def block(self) -> None:
        old, self.control = self.control, False
        self.need("{")
        self.statements(self.statement_end, "}")
        self.need("}")
        self.control = old

    def statement_end(self) -> None:
        if self.eat(";"):
            return
        self.statement()
        self.end()

    def statement(self) -> None:
        t = self.cur
        if t.k == "id":
            f = getattr(self, "st_" + t.t, None) if t.t in _RESERVED else None
            if f:
                return f()
            if t.t not in _RESERVED and self.ahead().t == ":" and not self.control:
                self.next()
                self.next()
                if not self.at("}", ";"):
                    self.statement()
                return None
        elif t.k == "op" and t.t == "{":
            return self.block()
        return self.simple()

    def simple(self) -> None:
        first = self.expressions()
        t = self.cur
        if t.k == "op" and t.t in _ASSIGN:
            if t.t == ":=" and first == "call" or t.t != ":=" and first in ("call", "literal"):
                self.fail("no target of an assignment")
            self.next()
            if self.at("range"):
                self.next()
                self.expression()
                return
            self.expressions()
        elif t.k == "op" and t.t in ("++", "--"):
            self.next()
        elif t.k == "op" and t.t == "<-":
            self.next()
            self.expression()
        elif not self.control and first not in ("call", "receive"):
            self.fail("a value is no statement")

    def st_var(self) -> None:
        self.declaration()

    st_const = st_type = st_var

    def st_func(self) -> None:
        self.simple()

    st_struct = st_map = st_chan = st_interface = st_func

    def st_return(self) -> None:
        self.next()
        if not (self.at(";", "}") or self.cur.k == EOF):
            self.expressions()

    def st_break(self) -> None:
        self.next()
        if self.cur.k == "id" and self.cur.t not in _RESERVED:
            self.next()

    st_continue = st_break

    def st_fallthrough(self) -> None:
        self.next()

    def st_goto(self) -> None:
        self.next()
        self.name()

    def st_go(self) -> None:
        self.next()
        if self.expression() != "call":
            self.fail("expected a call")

    st_defer = st_go

    def st_if(self) -> None:
        self.next()
        old, self.control = self.control, True
        if self.at("{"):
            self.fail("expected a condition")
        if not self.at(";"):
            self.simple()
        if self.eat(";"):
            self.simple()
        self.control = old
        self.block()
        if self.eat("else"):
            if self.at("if"):
                self.nest()
                self.st_if()
                self.depth -= 1
            else:
                self.block()

    def st_for(self) -> None:
        self.next()
        old, self.control = self.control, True
        if not self.at("{"):
            if self.at("range"):
                self.next()
                self.expression()
            else:
                if not self.at(";"):
                    self.simple()
                if self.eat(";"):
                    if not self.at(";"):
                        self.simple()
                    self.need(";")
                    if not self.at("{"):
                        self.simple()
        self.control = old
        self.block()

    def st_switch(self) -> None:
        self.next()
        old, self.control = self.control, True
        if not self.at("{"):
            if not self.at(";"):
                self.simple()
            if self.eat(";") and not self.at("{"):
                self.simple()
        self.control = old
        self.cases(self.case_values)

    def case_values(self) -> None:
        while True:
            if self.quiet(self.case_value) is None:
                self.type_()
            if not self.eat(","):
                return

    def case_value(self) -> None:
        self.expression()
        if not self.at(",", ":"):
            self.fail("no value")

    def st_select(self) -> None:
        self.next()
        self.cases(self.select_case)

    def select_case(self) -> None:
        old, self.control = self.control, True
        self.simple()
        self.control = old

    def cases(self, one) -> None:
        old, self.control = self.control, False
        self.need("{")
        while not self.at("}"):
            if self.at("default"):
                self.next()
            else:
                self.need("case")
                one()
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.cur.k == EOF:
                    self.fail("expected '}'")
                self.statement_end()
        self.need("}")
        self.control = old

    # -- expressions
    def expressions(self) -> str:
        node = self.expression()
        while self.eat(","):
            self.expression()
            node = "list" if node not in ("call",) else "call"
        return node

    def expression(self) -> str:
        return self.binary()

    def unary(self) -> str:
        t = self.cur
        if t.k == "op" and t.t in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.next()
            self.nest()
            if t.t == "<-" and self.at("chan"):
                self.next()
                self.type_()
            else:
                self.unary()
            self.depth -= 1
            return {"<-": "receive", "*": "target"}.get(t.t, "value")
        return self.subscripts(self.primary())

    def primary(self) -> str:
        t = self.cur
        if t.k in ("num", "str"):
            self.next()
            return "literal"
        if t.k == "op":
            if t.t == "(":
                self.next()
                old, self.control = self.control, False
                if self.quiet(self.closed_expression) is None:
                    self.type_()
                    self.need(")")
                self.control = old
                return "value"
            if t.t == "[":
                self.type_()
                return "type"
        if t.k == "id":
            if t.t == "func":
                self.next()
                self.signature()
                if self.at("{"):
                    self.block()
                    return "value"
                return "type"
            if t.t in ("struct", "map", "chan", "interface"):
                self.type_()
                return "type"
            if t.t not in _RESERVED:
                self.next()
                return "name"
        self.fail("expected a value")

    def closed_expression(self) -> None:
        self.expression()
        self.need(")")

    def subscripts(self, node: str) -> str:
        while self.cur.k == "op":
            t = self.cur.t
            if t == ".":
                self.next()
                if self.eat("("):
                    if not self.eat("type"):
                        self.type_()
                    self.need(")")
                    node = "value"
                else:
                    self.name()
                    node = "name" if node == "name" else "target"
            elif t == "(":
                self.next()
                old, self.control = self.control, False
                while not self.at(")"):
                    if self.quiet(self.argument) is None:
                        if self.quiet(self.type_argument) is None:
                            self.argument()
                    if not self.at(")"):
                        self.need(",")
                self.need(")")
                self.control = old
                node = "call"
            elif t == "[":
                self.next()
                old, self.control = self.control, False
                while not self.at("]"):
                    if self.at(":"):
                        self.next()
                    elif self.quiet(self.index) is None:
                        self.type_()
                        if not self.at("]"):
                            self.need(",")
                self.need("]")
                self.control = old
                node = "name" if node == "name" else "target"
            elif t == "{" and (node == "type" or node == "name" and not self.control):
                self.literal()
                node = "value"
            else:
                break
        return node

    def index(self) -> None:
        self.expression()
        if not self.at("]", ":", ","):
            self.fail("expected ']'")
        self.eat(",")

    def argument(self) -> None:
        self.expression()
        if self.at("..."):
            self.next()
        if not self.at(",", ")"):
            self.fail("expected ','")

    def type_argument(self) -> None:
        self.type_()
        if not self.at(",", ")"):
            self.fail("expected ','")

    def literal(self) -> None:
        self.nest()
        self.need("{")
        old, self.control = self.control, False
        while not self.at("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if not self.at("}"):
                self.need(",")
        self.need("}")
        self.control = old
        self.depth -= 1

    def element(self) -> None:
        if self.at("{"):
            self.literal()
        else:
            self.expression()


def parse(text: str, errors: list) -> None:
    Go(tokens(text, "go", errors), len(text), errors).whole()
