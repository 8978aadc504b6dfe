"""Java 17."""

from __future__ import annotations

from codestrata.llm.syntax.base import EOF, Parser
from codestrata.llm.syntax.clex import tokens

_PRIMITIVE = frozenset("boolean byte short int long char float double".split())
_RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}


class Java(Parser):
    STARTERS = frozenset("class interface enum public private protected static final if for while do switch try throw return import package int boolean String".split())
    BINARY = _BINARY

    def whole(self) -> None:
        self.statements(self.unit_part, None)

    def unit_part(self) -> None:
        if self.eat(";"):
            return None
        start = self.i
        self.modifiers()
        if self.at("package"):
            if any(t.t not in ("@",) and t.k == "id" and t.t in _MODIFIERS for t in self.toks[start : self.i]):
                self.fail("unexpected word")
            self.next()
            self.qualified()
            self.need(";")
            return None
        if self.at("import") and self.i == start:
            self.next()
            self.eat("static")
            self.name()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.name()
            self.need(";")
            return None
        if self.at("module", "open") and self.ahead().k == "id":
            self.eat("open")
            self.next()
            self.qualified()
            self.need("{")
            while not self.at("}"):
                if self.cur.k == EOF:
                    self.fail("expected '}'")
                self.next()
            self.need("}")
            return None
        if self.type_declaration():
            return None
        self.fail("expected a declaration of a type")

    def name(self) -> None:
        if self.cur.k != "id" or self.cur.t in _RESERVED:
            self.fail("expected a name")
        self.next()

    def qualified(self) -> None:
        self.name()
        while self.at(".") and self.ahead().k == "id":
            self.next()
            self.name()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.ahead().t != "interface":
                self.next()
                self.qualified()
                if self.at("("):
                    self.annotation_arguments()
            elif self.cur.k == "id" and self.cur.t in _MODIFIERS and not (self.cur.t == "default" and self.ahead().t in (":", "->")):
                if self.cur.t == "synchronized" and self.ahead().t == "(":
                    return
                self.next()
            elif self.at("sealed") and self.ahead().k == "id" or self.at("non") and self.ahead().t == "-":
                if self.next().t == "non":
                    self.next()
                    self.next()
            else:
                return

    def annotation_arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            if self.cur.k == "id" and self.ahead().t == "=":
                self.next()
                self.next()
            self.annotation_value()
            if not self.at(")"):
                self.need(",")
        self.need(")")

    def annotation_value(self) -> None:
        if self.at("{"):
            self.next()
            while not self.at("}"):
                self.annotation_value()
                if not self.at("}"):
                    self.need(",")
            self.need("}")
        elif self.at("@"):
            self.modifiers()
        else:
            self.conditional()

    # -- types
    def type_declaration(self) -> bool:
        if self.at("class"):
            self.next()
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.type_()
            if self.eat("implements"):
                self.type_list()
            if self.eat("permits"):
                self.type_list()
            self.class_body()
        elif self.at("interface") or self.at("@") and self.ahead().t == "interface":
            self.eat("@")
            self.next()
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.type_list()
            if self.eat("permits"):
                self.type_list()
            self.class_body()
        elif self.at("enum") and self.ahead().k == "id":
            self.next()
            self.name()
            if self.eat("implements"):
                self.type_list()
            self.need("{")
            while not self.at("}", ";"):
                self.modifiers()
                self.name()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.class_body()
                if not self.eat(","):
                    break
            if self.eat(";"):
                self.statements(self.member, "}")
            self.need("}")
        elif self.at("record") and self.ahead().k == "id" and self.ahead(2).t in ("(", "<"):
            self.next()
            self.name()
            self.type_params()
            self.params()
            if self.eat("implements"):
                self.type_list()
            self.class_body()
        else:
            return False
        return True

    def class_body(self) -> None:
        self.need("{")
        self.statements(self.member, "}")
        self.need("}")

    def member(self) -> None:
        if self.eat(";"):
            return None
        if self.at("{") or self.at("static") and self.ahead().t == "{":
            self.eat("static")
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return None
        self.type_params()
        self.modifiers()
        if self.cur.k == "id" and self.cur.t not in _RESERVED and self.ahead().t in ("(", "{"):
            self.next()
            if self.at("("):
                self.params()
            self.throws()
            return self.block()
        if not self.eat("void"):
            self.type_()
        self.name()
        if self.at("("):
            self.params()
            self.dims()
            self.throws()
            if self.eat("default"):
                self.annotation_value()
            if not self.eat(";"):
                self.block()
            return None
        self.declarator_rest()
        self.need(";")
        return None

    def throws(self) -> None:
        if self.eat("throws"):
            self.type_list()

    def params(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.modifiers()
            self.type_()
            self.modifiers()
            self.eat("...")
            if self.eat("this"):
                pass
            else:
                self.name()
                self.dims()
            if not self.at(")"):
                self.need(",")
                if self.at(")"):
                    self.fail("expected a parameter")
        self.need(")")

    def type_list(self) -> None:
        self.type_()
        while self.eat(","):
            self.type_()

    def type_params(self) -> None:
        if not self.eat("<"):
            return
        while True:
            self.modifiers()
            self.name()
            if self.eat("extends"):
                self.type_()
                while self.eat("&"):
                    self.type_()
            if self.eat(">"):
                return
            self.need(",")

    def type_(self, dims: bool = True) -> None:
        self.nest()
        self.modifiers()
        if self.cur.k == "id" and self.cur.t in _PRIMITIVE:
            self.next()
        else:
            self.name()
            while True:
                if self.at("<"):
                    self.type_args()
                elif self.at(".") and (self.ahead().k == "id" and self.ahead().t not in _RESERVED or self.ahead().t == "@"):
                    self.next()
                    self.modifiers()
                    self.name()
                else:
                    break
        if dims:
            self.dims()
        self.depth -= 1

    def dims(self) -> None:
        while self.at("[") and self.ahead().t == "]" or self.at("@"):
            if self.at("@"):
                self.modifiers()
                continue
            self.next()
            self.next()

    def type_args(self) -> None:
        self.need("<")
        if self.eat(">"):
            return
        while True:
            self.modifiers()
            if self.eat("?"):
                if self.eat("extends") or self.eat("super"):
                    self.type_()
            else:
                self.type_()
            if self.eat(">"):
                return
            self.need(",")

    # -- statements
    def declarator_rest(self) -> None:
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.at("{"):
            self.array_values()
        else:
            self.expression()

    def array_values(self) -> None:
        self.nest()
        self.need("{")
        while not self.at("}"):
            self.initializer()
            if not self.at("}"):
                self.need(",")
        self.need("}")
        self.depth -= 1

    def block(self) -> None:
        self.need("{")
        self.statements(self.statement, "}")
        self.need("}")

    def statement(self) -> None:
        t = self.cur
        if t.k == "op":
            if t.t == "{":
                return self.block()
            if self.eat(";"):
                return None
        elif t.k == "id":
            f = getattr(self, "st_" + t.t, None)
            if f and not (t.t == "yield" and self.ahead().t in ("=", ".", "(", "++", "--", "[")) and not (t.t == "synchronized" and self.ahead().t != "("):
                return f()
            if self.ahead().t == ":" and t.t not in _RESERVED:
                self.next()
                self.next()
                return self.statement()
        if self.at("final", "abstract", "static", "strictfp", "@", "class", "interface", "enum", "record", "sealed"):
            i = self.i
            self.modifiers()
            if self.type_declaration():
                return None
            if self.i == i and t.t in ("record", "sealed"):
                pass
            else:
                self.local()
                return self.end()
        if self.local_follows():
            self.local()
            return self.end()
        node = self.expression()
        if node != "action":
            self.fail("not a statement")
        return self.end()

    def end(self) -> None:
        self.need(";")

    def local_follows(self) -> bool:
        if self.cur.k != "id" or self.cur.t in _RESERVED and self.cur.t not in _PRIMITIVE:
            return False
        i, n, d = self.i, len(self.errors), self.depth
        ok = self.quiet(self.local_head)
        self.depth = d
        self.seek(i)
        del self.errors[n:]
        return bool(ok)

    def local_head(self) -> None:
        self.type_()
        self.name()
        if not self.at("=", ";", ",", ":", "[") and not self.cur.nl and not self.cur.k == EOF:
            if self.cur.k == "op" and self.cur.t not in (")",):
                self.fail("no local variable")

    def local(self) -> None:
        self.type_()
        self.name()
        self.declarator_rest()

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

    def st_do(self) -> None:
        self.next()
        self.statement()
        self.need("while")
        self.paren()
        self.end()

    def st_for(self) -> None:
        self.next()
        self.need("(")
        if not self.at(";"):
            if self.at("final", "@") or self.local_follows():
                self.modifiers()
                self.type_()
                self.name()
                if self.eat(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.declarator_rest()
            else:
                self.actions()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.actions()
        self.need(")")
        return self.statement()

    def actions(self) -> None:
        while True:
            if self.expression() != "action":
                self.fail("not a statement")
            if not self.eat(","):
                return

    def st_switch(self) -> None:
        self.switch()
        if self.at("."):
            self.subscripts("value")
            self.end()

    def switch(self) -> None:
        self.need("switch")
        self.paren()
        self.need("{")
        while not self.at("}"):
            if self.eat("default"):
                pass
            else:
                self.need("case")
                while True:
                    if not self.eat("default"):
                        if self.local_follows() and self.ahead().k == "id":
                            self.modifiers()
                            self.type_()
                            self.name()
                        else:
                            self.conditional()
                    if not self.eat(","):
                        break
            if self.eat("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.end()
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    if self.cur.k == EOF:
                        self.fail("expected '}'")
                    self.statement()
        self.need("}")

    def st_try(self) -> None:
        self.next()
        resources = caught = False
        if self.eat("("):
            resources = True
            while not self.at(")"):
                if self.at("final", "@") or self.local_follows():
                    self.modifiers()
                    self.type_()
                    self.name()
                    self.need("=")
                self.expression()
                if not self.at(")"):
                    self.need(";")
            self.need(")")
        self.block()
        while self.eat("catch"):
            caught = True
            self.need("(")
            self.modifiers()
            self.type_()
            while self.eat("|"):
                self.type_()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            self.block()
        elif not caught and not resources:
            self.fail("expected 'catch' or 'finally'")

    def st_throw(self) -> None:
        self.next()
        self.expression()
        self.end()

    st_yield = st_throw

    def st_return(self) -> None:
        self.next()
        if not self.at(";"):
            self.expression()
        self.end()

    def st_break(self) -> None:
        self.next()
        if self.cur.k == "id":
            self.name()
        self.end()

    st_continue = st_break

    def st_assert(self) -> None:
        self.next()
        self.expression()
        if self.eat(":"):
            self.expression()
        self.end()

    def st_synchronized(self) -> None:
        self.next()
        self.paren()
        self.block()

    # -- expressions
    def expression(self) -> str:
        self.nest()
        node = self.expression_()
        self.depth -= 1
        return node

    def expression_(self) -> str:
        if self.lambda_follows():
            if self.at("("):
                self.next()
                while not self.at(")"):
                    if self.cur.k == "id" and self.ahead().t in (",", ")"):
                        self.name()
                    else:
                        self.modifiers()
                        self.type_()
                        self.eat("...")
                        self.name()
                        self.dims()
                    if not self.at(")"):
                        self.need(",")
                self.need(")")
            else:
                self.name()
            self.need("->")
            if self.at("{"):
                self.block()
            else:
                self.expression()
            return "value"
        node = self.conditional()
        if self.cur.k == "op" and self.cur.t in _ASSIGN:
            if node != "target":
                self.fail("no target of an assignment")
            self.next()
            self.expression()
            return "action"
        return node

    def lambda_follows(self) -> bool:
        if self.cur.k == "id" and self.ahead().t == "->" and self.cur.t not in _RESERVED:
            return True
        if self.at("("):
            j = self.partner.get(self.i)
            return j is not None and self.toks[j + 1].t == "->"
        return False

    def conditional(self) -> str:
        node = self.binary()
        if self.eat("?"):
            self.expression()
            self.need(":")
            if self.lambda_follows():
                self.expression()
            else:
                self.conditional()
            return "value"
        return node

    def binary(self, least: int = 1) -> str:
        self.nest()
        node = self.unary()
        while self.cur.k in ("op", "id"):
            t = self.cur
            p, width = _BINARY.get(t.t), 1
            if p is None:
                break
            if t.t == ">" and (n := self.ahead()).t in (">", ">=", ">>=") and n.p == t.p + 1:
                if n.t != ">":
                    break
                width, p = (3 if (m := self.ahead(2)).t == ">" and m.p == n.p + 1 else 2), 8
            if p < least:
                break
            for _ in range(width):
                self.next()
            if t.t == "instanceof":
                self.modifiers()
                self.type_()
                if self.cur.k == "id" and self.cur.t not in _RESERVED:
                    self.next()
            else:
                self.binary(p + 1)
            node = "value"
        self.depth -= 1
        return node

    def unary(self) -> str:
        self.nest()
        node = self.unary_()
        self.depth -= 1
        return node

    def unary_(self) -> str:
        t = self.cur
        if t.k == "op":
            if t.t in ("++", "--"):
                self.next()
                if self.unary() != "target":
                    self.fail("no target")
                return "action"
            if t.t in ("+", "-", "!", "~"):
                self.next()
                self.unary()
                return "value"
            if t.t == "(" and self.cast():
                return "value"
        node = self.subscripts(self.primary())
        while self.at("++", "--"):
            if node != "target":
                self.fail("no target")
            self.next()
            node = "action"
        return node

    def cast(self) -> bool:
        j = self.partner.get(self.i)
        if j is None:
            return False
        n = self.toks[j + 1]
        primitive = self.ahead().t in _PRIMITIVE and self.ahead().k == "id"
        if not primitive and not (n.k in ("id", "str", "num") and n.t not in ("instanceof",) or n.k == "op" and n.t in ("(", "!", "~")):
            return False

        def head():
            self.next()
            self.type_()
            while self.eat("&"):
                self.type_()
            if self.i != j:
                self.fail("no cast")
            self.next()

        if not self.quiet(head):
            return False
        if self.lambda_follows():
            self.expression()
        else:
            self.unary()
        return True

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.expression()
            if not self.at(")"):
                self.need(",")
                if self.at(")"):
                    self.fail("expected a value")
        self.need(")")

    def subscripts(self, node: str) -> str:
        while self.cur.k == "op":
            t = self.cur.t
            if t == ".":
                self.next()
                if self.at("<"):
                    self.type_args()
                if self.at("new"):
                    self.new()
                    node = "action"
                elif self.eat("this") or self.eat("class"):
                    node = "value"
                elif self.eat("super"):
                    node = "value"
                else:
                    self.name()
                    node = "target"
            elif t == "[":
                self.next()
                self.expression()
                self.need("]")
                node = "target"
            elif t == "(" and node in ("target", "callable"):
                self.arguments()
                node = "action"
            elif t == "::":
                self.next()
                if not self.eat("new"):
                    self.name()
                node = "value"
            else:
                break
        return node

    def primary(self) -> str:
        t = self.cur
        if t.k in ("str", "num"):
            self.next()
            return "value"
        if t.k == "op" and t.t == "(":
            self.next()
            node = self.expression()
            self.need(")")
            return node if node == "target" else "value"
        if t.k == "id":
            if t.t in ("true", "false", "null"):
                self.next()
                return "value"
            if t.t in ("this", "super"):
                self.next()
                return "callable"
            if t.t == "new":
                return self.new()
            if t.t == "switch":
                self.switch()
                return "value"
            if t.t in _PRIMITIVE or t.t == "void":
                self.next()
                self.dims()
                if self.at("::"):
                    return "value"
                self.need(".")
                self.need("class")
                return "value"
            if t.t not in _RESERVED:
                if self.ahead().t in ("<", "[") and self.quiet(self.typed_reference):
                    return "value"
                self.next()
                return "target"
        self.fail("expected a value")

    def typed_reference(self) -> None:
        self.type_()
        if self.at("::"):
            return
        if self.at(".") and self.ahead().t == "class" and self.toks[self.i - 1].t == "]":
            return
        self.fail("no reference")

    def new(self) -> str:
        self.need("new")
        self.modifiers()
        if self.at("<"):
            self.type_args()
        self.type_(dims=False)
        if self.at("["):
            sized = False
            while self.eat("["):
                if not self.at("]"):
                    self.expression()
                    sized = True
                self.need("]")
                if sized and self.at("[") is False:
                    break
            if self.at("{"):
                if sized:
                    self.fail("size and values")
                self.array_values()
            elif not sized:
                self.fail("expected values")
            return "value"
        self.arguments()
        if self.at("{"):
            self.class_body()
        return "action"


def parse(text: str, errors: list) -> None:
    Java(tokens(text, "java", errors), len(text), errors).whole()
