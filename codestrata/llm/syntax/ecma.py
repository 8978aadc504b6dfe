"""JavaScript (script or module) and TypeScript 5."""

from __future__ import annotations

from codestrata.llm.syntax.base import EOF, Parser, Tok
from codestrata.llm.syntax.clex import tokens

_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_TARGETS = ("id", "member", "array", "object", "cover")
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor".split())


class Js(Parser):
    TS = False
    STARTERS = frozenset("var let const function class if for while do switch try throw return import export async interface type enum namespace".split())
    BINARY = _BINARY

    def __init__(self, toks, end, errors, fn=0, loop=0, is_async=False):
        super().__init__(toks, end, errors)
        self.fn, self.loop, self.no_in, self.is_async, self.in_switch = fn, loop, False, is_async, 0

    def whole(self) -> None:
        self.statements(self.statement, None)

    # -- statements
    def semi(self) -> None:
        if self.eat(";") or self.at("}") or self.cur.k == EOF or self.cur.nl:
            return
        self.fail("expected ';'")

    def name(self, any_word: bool = False) -> None:
        if self.cur.k != "id" or not any_word and (self.cur.t in _RESERVED or self.cur.t[0] == "#"):
            self.fail("expected a name")
        self.next()

    def block(self) -> None:
        self.need("{")
        self.statements(self.statement, "}")
        self.need("}")

    def statement(self) -> None:
        t = self.cur
        if t.k == "op":
            if t.t == "{":
                return self.block()
            if t.t == ";":
                self.next()
                return None
            if t.t == "@":
                self.decorators()
                return self.statement()
        elif t.k == "id":
            n = self.ahead()
            f = getattr(self, "st_" + t.t, None) if t.t in _RESERVED else None
            if f and not (t.t == "import" and n.k == "op" and n.t in ("(", ".")):
                return f()
            if t.t in _RESERVED and t.t not in ("this", "super", "null", "true", "false", "typeof", "delete", "void", "new", "import", "function", "class"):
                self.fail("unexpected word")
            if t.t == "let" and (n.k == "id" and n.t not in ("in", "of", "instanceof") or n.t in ("[", "{")):
                return self.st_var()
            if t.t == "async" and n.t == "function" and not n.nl:
                self.next()
                return self.function(True, True)
            if n.k == "op" and n.t == ":" and t.t not in _RESERVED:
                self.next()
                self.next()
                return self.statement()
            if self.TS and (f := getattr(self, "ts_" + t.t, None)) and self.ts_starts(t, n):
                return f()
        self.expression()
        self.semi()
        return None

    def ts_starts(self, t: Tok, n: Tok) -> bool:
        return False

    def st_var(self) -> None:
        kind = self.next().t
        if kind == "const" and self.TS and self.at("enum"):
            return self.ts_enum()
        self.declarators(kind)
        self.semi()
        return None

    st_const = st_var

    def declarators(self, kind: str, in_for: bool = False) -> int:
        n = 0
        while True:
            pattern = self.at("[", "{")
            self.binding()
            if self.TS:
                self.eat("!")
                self.type_mark()
            if self.eat("="):
                self.assignment()
            elif not in_for and (pattern or kind == "const") and not self.ambient:
                self.fail("expected '='")
            n += 1
            if not self.eat(","):
                return n

    ambient = False

    def binding(self) -> None:
        self.nest()
        if self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
            self.need("]")
        elif self.eat("{"):
            while not self.at("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    short = self.cur.k == "id" and self.cur.t not in _RESERVED
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif not short:
                        self.fail("expected ':'")
                    if self.eat("="):
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
            self.need("}")
        else:
            self.name()
        self.depth -= 1

    def st_function(self) -> None:
        self.function(False, True)

    def function(self, is_async: bool, named: bool) -> None:
        self.need("function")
        self.eat("*")
        if self.cur.k == "id" and self.cur.t not in _RESERVED:
            self.next()
        elif named:
            self.fail("expected a name")
        self.signature_and_body(is_async)

    def signature_and_body(self, is_async: bool, bodyless: bool = False) -> None:
        if self.TS:
            self.type_params()
        self.params()
        if self.TS:
            self.type_mark(returns=True)
            if not self.at("{"):
                return self.semi()
        self.body(is_async)
        return None

    def body(self, is_async: bool) -> None:
        old = (self.fn, self.loop, self.no_in, self.is_async, self.in_switch)
        self.fn, self.loop, self.no_in, self.is_async, self.in_switch = 1, 0, False, is_async, 0
        try:
            self.block()
        finally:
            self.fn, self.loop, self.no_in, self.is_async, self.in_switch = old

    def params(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.decorators()
            if self.TS:
                while self.cur.t in _MODIFIERS and self.ahead().k == "id":
                    self.next()
                if self.at("this") and self.ahead().t in (":", ",", ")"):
                    self.next()
                    self.type_mark()
                    if not self.at(")"):
                        self.need(",")
                    continue
            rest = self.eat("...")
            self.binding()
            if self.TS:
                self.eat("?")
                self.type_mark()
            if self.eat("="):
                self.assignment()
            if rest and not self.at(")"):
                self.fail("nothing may follow a rest parameter")
            if not self.at(")"):
                self.need(",")
        self.need(")")

    def st_class(self) -> None:
        self.class_(True)

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.cur.k == "id" and self.cur.t not in _RESERVED and self.cur.t != "implements":
            self.next()
        elif named:
            self.fail("expected a name")
        if self.TS:
            self.type_params()
        if self.eat("extends"):
            self.subscripts(self.primary())
            if self.TS:
                self.quiet(self.type_args)
        if self.TS and self.eat("implements"):
            self.type_list()
        self.need("{")
        self.statements(self.member, "}")
        self.need("}")

    def member(self) -> None:
        if self.eat(";"):
            return
        self.decorators()
        is_async = False
        while self.cur.k == "id" and (self.cur.t in ("static", "async", "get", "set", "accessor") or self.TS and self.cur.t in _MODIFIERS):
            n = self.ahead()
            if n.k == "op" and n.t in ("(", "=", ";", "}", ":", "?", "!", "<") and not (n.t == "{" and self.cur.t == "static"):
                break
            if n.nl and self.cur.t not in ("static",) or n.k == EOF:
                break
            is_async |= self.cur.t == "async"
            if self.cur.t == "static" and n.t == "{":
                self.next()
                self.body(False)
                return
            self.next()
        self.eat("*")
        if self.TS and self.at("[") and self.ahead().k == "id" and self.ahead(2).t == ":":
            self.index_signature()
            return self.semi()
        self.property_name(private=True)
        if self.TS:
            self.eat("?") or self.eat("!")
        if self.at("(", "<"):
            return self.signature_and_body(is_async)
        if self.TS:
            self.type_mark()
        if self.eat("="):
            old, self.fn = self.fn, 1
            self.assignment()
            self.fn = old
        self.semi()
        return None

    def property_name(self, private: bool = False) -> None:
        if self.cur.k in ("str", "num"):
            self.next()
        elif self.cur.k == "id" and (private or self.cur.t[0] != "#"):
            self.next()
        elif self.eat("["):
            self.assignment()
            self.need("]")
        else:
            self.fail("expected a property name")

    def decorators(self) -> None:
        while self.at("@"):
            self.next()
            if self.at("("):
                self.next()
                self.expression()
                self.need(")")
            else:
                self.name(True)
                while self.eat("."):
                    self.name(True)
                if self.at("("):
                    self.arguments()

    def st_if(self) -> None:
        self.next()
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def looped(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    def st_while(self) -> None:
        self.next()
        self.paren()
        self.looped()

    def st_do(self) -> None:
        self.next()
        self.looped()
        self.need("while")
        self.paren()
        self.eat(";")

    def st_for(self) -> None:
        self.next()
        self.eat("await")
        self.need("(")
        old, self.no_in = self.no_in, True
        each = False
        if not self.at(";"):
            if self.at("var", "const") or self.at("let") and (self.ahead().k == "id" or self.ahead().t in ("[", "{")):
                start, kind = self.i, self.next().t
                n = self.declarators(kind, True)
                each = n == 1 and self.at("of", "in")
                if not each and kind == "const" and not any(x.t == "=" for x in self.toks[start : self.i]):
                    self.fail("expected '='")
            else:
                node = self.expression()
                each = node in _TARGETS and self.at("of", "in")
        self.no_in = old
        if each:
            of = self.next().t == "of"
            self.assignment() if of else self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.looped()

    def st_switch(self) -> None:
        self.next()
        self.paren()
        self.need("{")
        self.in_switch += 1
        while not self.at("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.cur.k == EOF:
                    self.fail("expected '}'")
                self.statement()
        self.in_switch -= 1
        self.need("}")

    def st_try(self) -> None:
        self.next()
        self.block()
        caught = False
        if self.eat("catch"):
            caught = True
            if self.eat("("):
                self.binding()
                if self.TS:
                    self.type_mark()
                self.need(")")
            self.block()
        if self.eat("finally"):
            self.block()
        elif not caught:
            self.fail("expected 'catch' or 'finally'")

    def st_throw(self) -> None:
        self.next()
        if self.cur.nl:
            self.fail("expected a value")
        self.expression()
        self.semi()

    def st_return(self) -> None:
        if not self.fn:
            self.errors.append((self.cur.p, "'return' outside a function"))
        self.next()
        if not (self.at(";", "}") or self.cur.k == EOF or self.cur.nl):
            self.expression()
        self.semi()

    def st_break(self) -> None:
        t = self.next()
        label = self.cur.k == "id" and not self.cur.nl and self.cur.t not in _RESERVED
        if label:
            self.next()
        elif not self.loop and not (t.t == "break" and self.in_switch):
            self.errors.append((t.p, f"{t.t!r} outside a loop"))
        self.semi()

    st_continue = st_break

    def st_debugger(self) -> None:
        self.next()
        self.semi()

    def st_with(self) -> None:
        self.next()
        self.paren()
        self.statement()

    def st_enum(self) -> None:
        if not self.TS:
            self.fail("unexpected word")
        self.ts_enum()

    def ts_enum(self) -> None:
        self.fail("unexpected word")

    # -- modules
    def module_name(self) -> None:
        if self.cur.k != "str":
            self.fail("expected a module name")
        self.next()
        if self.at("with", "assert") and self.ahead().t == "{":
            self.next()
            self.primary()

    def specifiers(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.TS and self.at("type") and self.ahead().k in ("id", "str") and self.ahead().t != "as":
                self.next()
            if self.cur.k == "str":
                self.next()
            else:
                self.name(True)
            if self.eat("as"):
                if self.cur.k == "str":
                    self.next()
                else:
                    self.name(True)
            if not self.at("}"):
                self.need(",")
        self.need("}")

    def st_import(self) -> None:
        self.next()
        if self.cur.k == "str":
            self.module_name()
            return self.semi()
        if self.TS and self.at("type") and (self.ahead().t in ("{", "*") or self.ahead().k == "id" and self.ahead().t != "from"):
            self.next()
        if self.cur.k == "id":
            self.name()
            if self.TS and self.eat("="):
                self.expression()
                return self.semi()
            if not self.eat(","):
                self.need("from")
                self.module_name()
                return self.semi()
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers()
        self.need("from")
        self.module_name()
        return self.semi()

    def st_export(self) -> None:
        self.next()
        if self.eat("default"):
            if self.at("function") or self.at("async") and self.ahead().t == "function":
                return self.function(self.eat("async"), False)
            if self.at("class"):
                return self.class_(False)
            if self.TS and (self.at("abstract") and self.ahead().t == "class" or self.at("interface") and self.ahead().k == "id"):
                return self.statement()
            self.assignment()
            return self.semi()
        if self.eat("*"):
            if self.eat("as"):
                self.name(True)
            self.need("from")
            self.module_name()
            return self.semi()
        if self.TS and self.at("type") and self.ahead().t in ("{", "*"):
            self.next()
            if self.eat("*"):
                self.need("from")
                self.module_name()
                return self.semi()
        if self.at("{"):
            self.specifiers()
            if self.eat("from"):
                self.module_name()
            return self.semi()
        if self.TS and self.at("=", "as", "import"):
            if self.at("import"):
                return self.statement()
            if self.next().t == "as":
                self.need("namespace")
                self.name()
            else:
                self.expression()
            return self.semi()
        words = ("var", "let", "const", "function", "class", "async", "@")
        if self.at(*words) or self.TS and self.at("interface", "type", "enum", "namespace", "module", "abstract", "declare"):
            return self.statement()
        self.fail("expected a declaration")

    # -- expressions
    def expression(self) -> str:
        node = self.assignment()
        while self.eat(","):
            node = "value"
            self.assignment()
        return node

    def arrow_body(self, is_async: bool) -> str:
        if self.at("{"):
            self.body(is_async)
        else:
            self.assignment()
        return "arrow"

    def arrow(self, is_async: bool) -> str:
        if self.TS:
            self.type_params()
        self.params()
        if self.TS:
            self.type_mark(returns=True)
        if self.cur.nl:
            self.fail("line end before '=>'")
        self.need("=>")
        return "arrow"

    def assignment(self) -> str:
        self.nest()
        node = self.assignment_()
        self.depth -= 1
        return node

    def assignment_(self) -> str:
        t, n = self.cur, self.ahead()
        if t.k == "id" and t.t not in _RESERVED:
            if n.k == "op" and n.t == "=>" and not n.nl:
                self.next()
                self.next()
                return self.arrow_body(False)
            if t.t == "async" and not n.nl:
                if n.k == "id" and n.t not in _RESERVED and self.ahead(2).t == "=>":
                    self.next()
                    self.next()
                    self.next()
                    return self.arrow_body(True)
                if n.k == "op" and n.t in ("(", "<") and self.arrow_follows(self.i + 1):
                    i = self.i
                    self.next()
                    if self.quiet(self.arrow, True):
                        return self.arrow_body(True)
                    self.seek(i)
            if t.t == "yield" and self.fn:
                self.next()
                self.eat("*")
                if not (self.at(")", "]", "}", ",", ";", ":") or self.cur.k == EOF or self.cur.nl):
                    self.assignment()
                return "value"
        if t.k == "op" and (t.t == "(" or t.t == "<" and self.TS) and self.arrow_follows(self.i):
            if self.quiet(self.arrow, False):
                return self.arrow_body(False)
        node = self.binary()
        if self.at("?"):
            self.next()
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old
            self.need(":")
            self.assignment()
            return "value"
        if self.cur.k == "op" and self.cur.t in _ASSIGN:
            if node not in _TARGETS or node in ("array", "object", "cover") and self.cur.t != "=":
                self.fail("no target of an assignment")
            self.next()
            self.assignment()
            return "value"
        if node == "cover" and not self.at("of", "in", "=>", ")", "]", "}", ","):
            self.fail("unexpected '='")
        return node

    def arrow_follows(self, i: int) -> bool:
        if self.toks[i].t == "<":
            return True
        j = self.partner.get(i)
        if j is None:
            return False
        n = self.toks[j + 1]
        return n.k == "op" and (n.t == "=>" or self.TS and n.t == ":")

    def allow_binary(self) -> bool:
        t = self.cur
        return not (t.t == "in" and self.no_in)

    def binary(self, least: int = 1) -> str:
        self.nest()
        node = self.unary()
        while True:
            t = self.cur
            if t.k not in ("op", "id"):
                break
            if self.TS and t.t in ("as", "satisfies") and t.k == "id" and not t.nl:
                if least > 8:
                    break
                self.next()
                if not self.eat("const"):
                    self.type_()
                node = "value"
                continue
            p = self.BINARY.get(t.t)
            if p is None or t.t == "in" and self.no_in:
                break
            width = 1
            if t.t == ">" and (n := self.ahead()).t in (">", ">=", ">>=") and n.p == t.p + 1:
                if n.t != ">":
                    break
                width = 3 if (m := self.ahead(2)).t == ">" and m.p == n.p + 1 else 2
                p = 9
            if t.t == "<" and (n := self.ahead()).t == "<" and n.p == t.p + 1:
                width, p = 2, 9
            if p < least:
                break
            for _ in range(width):
                self.next()
            self.binary(p if t.t == "**" else p + 1)
            node = "value"
        self.depth -= 1
        return node

    def unary(self) -> str:
        t = self.cur
        if t.k == "op":
            if t.t in ("!", "~", "+", "-"):
                self.next()
                self.nested_unary()
                return "value"
            if t.t in ("++", "--"):
                self.next()
                if self.nested_unary() not in ("id", "member"):
                    self.fail("no target")
                return "value"
            if t.t == "<" and self.TS:
                self.next()
                self.type_()
                self.need(">")
                self.nested_unary()
                return "value"
        elif t.k == "id" and t.t in ("typeof", "void", "delete"):
            self.next()
            self.nested_unary()
            return "value"
        elif t.k == "id" and t.t == "await" and (self.is_async or not self.fn) and not self.ahead().nl and not (self.ahead().k == "op" and self.ahead().t in (")", ";", ",", "=", ".", "=>", "]", "}", ":", "?")):
            self.next()
            self.nested_unary()
            return "value"
        node = self.subscripts(self.primary())
        if self.at("++", "--") and not self.cur.nl and self.cur.k == "op":
            if node not in ("id", "member"):
                self.fail("no target")
            self.next()
            return "value"
        return node

    def nested_unary(self) -> str:
        self.nest()
        node = self.unary()
        self.depth -= 1
        return node

    def arguments(self) -> None:
        self.need("(")
        old, self.no_in = self.no_in, False
        while not self.at(")"):
            self.eat("...")
            self.assignment()
            if not self.at(")"):
                self.need(",")
        self.need(")")
        self.no_in = old

    def subscripts(self, node: str, calls: bool = True) -> str:
        while True:
            t = self.cur
            if t.k == "tpl":
                self.template(self.next())
                node = "value"
            elif t.k != "op":
                return node
            elif t.t == ".":
                self.next()
                self.name(True)
                node = "member"
            elif t.t == "?.":
                self.next()
                if self.at("("):
                    self.arguments()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                elif self.cur.k == "tpl":
                    self.fail("unexpected template")
                else:
                    self.name(True)
                node = "value"
            elif t.t == "[":
                self.next()
                old, self.no_in = self.no_in, False
                self.expression()
                self.no_in = old
                self.need("]")
                node = "member"
            elif t.t == "(" and calls:
                if node == "arrow":
                    return node
                self.arguments()
                node = "value"
            elif self.TS and t.t == "!" and not t.nl and self.ahead().t not in ("=",):
                self.next()
            elif self.TS and t.t == "<" and self.quiet(self.call_type_args):
                node = "value" if not self.at("(") or not calls else node
            else:
                return node

    def template(self, t: Tok) -> None:
        for sub, end in t.sub:
            if not sub:
                self.errors.append((end, "expected a value"))
                continue
            p = type(self)(list(sub), end, self.errors, self.fn, self.loop, self.is_async)
            p.depth = self.depth + 2
            n = len(self.errors)
            p.quiet_whole()
            if len(self.errors) > n:
                from codestrata.llm.syntax.base import Bail

                raise Bail

    def quiet_whole(self) -> None:
        from codestrata.llm.syntax.base import Bail

        try:
            self.expression()
            if self.cur.k != EOF:
                self.fail("expected '}'")
        except Bail:
            pass

    def primary(self) -> str:
        t = self.cur
        if t.k in ("str", "num", "rx"):
            self.next()
            return "value"
        if t.k == "tpl":
            self.template(self.next())
            return "value"
        if t.k == "id":
            w = t.t
            if w == "function":
                self.function(False, False)
                return "value"
            if w == "async" and self.ahead().t == "function" and not self.ahead().nl:
                self.next()
                self.function(True, False)
                return "value"
            if w == "class":
                self.class_(False)
                return "value"
            if w == "new":
                return self.new()
            if w == "import":
                self.next()
                if self.eat("."):
                    self.name(True)
                elif not self.at("("):
                    self.fail("unexpected word")
                return "value"
            if w == "super":
                self.next()
                if not self.at("(", ".", "["):
                    self.fail("unexpected 'super'")
                return "value"
            if w in ("this", "null", "true", "false"):
                self.next()
                return "value"
            if w in _RESERVED:
                self.fail("unexpected word")
            if w[0] == "#":
                self.next()
                if not self.at("in"):
                    self.fail("expected 'in'")
                return "value"
            self.next()
            return "id"
        if t.k == "op":
            if t.t == "(":
                self.next()
                old, self.no_in = self.no_in, False
                node = self.expression()
                self.no_in = old
                self.need(")")
                if node == "cover":
                    self.fail("unexpected '='")
                return node if node in ("id", "member") else "value"
            if t.t == "[":
                return self.array()
            if t.t == "{":
                return self.object()
            if t.t == "@":
                self.decorators()
                self.class_(False)
                return "value"
        self.fail("expected a value")

    def new(self) -> str:
        self.next()
        if self.eat("."):
            self.name(True)
            return "value"
        self.nest()
        if self.at("new"):
            self.new()
        else:
            self.subscripts(self.primary(), calls=False)
        self.depth -= 1
        if self.at("("):
            self.arguments()
        return "value"

    def array(self) -> str:
        self.need("[")
        old, self.no_in = self.no_in, False
        node = "array"
        while not self.at("]"):
            if self.eat(","):
                continue
            self.eat("...")
            if self.assignment() == "cover":
                node = "cover"
            if not self.at("]"):
                self.need(",")
        self.need("]")
        self.no_in = old
        return node

    def object(self) -> str:
        self.need("{")
        old, self.no_in = self.no_in, False
        node = "object"
        while not self.at("}"):
            if self.eat("..."):
                self.assignment()
            else:
                is_async, start = False, self.i
                while self.cur.t in ("async", "get", "set") and self.cur.k == "id" and not (self.ahead().k == "op" and self.ahead().t in (",", ":", "(", "}", "=", "<")):
                    is_async |= self.next().t == "async"
                star = self.eat("*")
                short = self.cur.k == "id" and self.cur.t not in _RESERVED and self.i == start
                self.property_name()
                if self.at("(") or self.TS and self.at("<"):
                    self.signature_and_body(is_async)
                elif star:
                    self.fail("expected '('")
                elif self.eat(":"):
                    if self.assignment() == "cover":
                        node = "cover"
                elif not short:
                    self.fail("expected ':'")
                elif self.eat("="):
                    self.assignment()
                    node = "cover"
            if not self.at("}"):
                self.need(",")
        self.need("}")
        self.no_in = old
        return node

    # -- hooks of TypeScript
    def type_mark(self, returns: bool = False) -> None:
        pass

    def type_params(self) -> None:
        pass

    def call_type_args(self) -> None:
        self.fail("no type")


class Ts(Js):
    TS = True

    def ts_starts(self, t, n) -> bool:
        if t.t in ("interface", "type"):
            return n.k == "id" and not n.nl
        if t.t in ("namespace", "module"):
            return n.k in ("id", "str") and not n.nl
        if t.t == "global":
            return n.t == "{"
        return n.k == "id" and not n.nl

    def ts_interface(self) -> None:
        self.next()
        self.name()
        self.type_params()
        if self.eat("extends"):
            self.type_list()
        self.object_type()

    def ts_type(self) -> None:
        self.next()
        self.name()
        self.type_params()
        self.need("=")
        self.type_()
        self.semi()

    def ts_enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.at("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.need(",")
        self.need("}")

    def ts_namespace(self) -> None:
        self.next()
        if self.cur.k == "str":
            self.next()
            if not self.at("{"):
                return self.semi()
        else:
            self.name()
            while self.eat("."):
                self.name()
        self.block()
        return None

    ts_module = ts_namespace

    def ts_global(self) -> None:
        self.next()
        self.block()

    def ts_abstract(self) -> None:
        self.next()
        self.class_(True)

    def ts_declare(self) -> None:
        self.next()
        old, self.ambient = self.ambient, True
        try:
            self.statement()
        finally:
            self.ambient = old

    def type_list(self) -> None:
        self.type_()
        while self.eat(","):
            self.type_()

    def type_mark(self, returns: bool = False) -> None:
        if self.eat(":"):
            self.type_(returns)

    def type_params(self) -> None:
        if not self.eat("<"):
            return
        while True:
            while self.at("const", "in", "out") and self.ahead().k == "id":
                self.next()
            self.name()
            if self.eat("extends"):
                self.type_()
            if self.eat("="):
                self.type_()
            if self.eat(">"):
                return
            self.need(",")
            if self.eat(">"):
                return

    def type_args(self) -> None:
        self.need("<")
        while True:
            self.type_()
            if self.eat(">"):
                return
            self.need(",")

    def call_type_args(self) -> None:
        self.type_args()
        if not (self.at("(", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "}", "=") or self.cur.k in ("tpl", EOF) or self.cur.nl):
            self.fail("no call")

    def type_(self, returns: bool = False) -> None:
        self.nest()
        t, n = self.cur, self.ahead()
        if returns and t.k == "id" and t.t == "asserts" and n.k == "id" and not n.nl:
            self.next()
            self.next()
            if self.eat("is"):
                self.type_()
        elif returns and t.k == "id" and n.t == "is" and n.k == "id" and not n.nl:
            self.next()
            self.next()
            self.type_()
        elif self.function_type_follows():
            self.eat("abstract")
            self.eat("new")
            self.type_params()
            self.params()
            self.need("=>")
            self.type_(True)
        else:
            self.union()
            if self.at("extends") and not self.cur.nl and not self.no_conditional:
                self.next()
                old, self.no_conditional = self.no_conditional, True
                self.type_()
                self.no_conditional = old
                self.need("?")
                self.type_()
                self.need(":")
                self.type_()
        self.depth -= 1

    no_conditional = False

    def function_type_follows(self) -> bool:
        t = self.cur
        if t.t == "<" and t.k == "op" or t.t == "new" and t.k == "id" or t.t == "abstract" and self.ahead().t == "new":
            return True
        if t.t == "(" and t.k == "op":
            j = self.partner.get(self.i)
            return j is not None and self.toks[j + 1].t == "=>"
        return False

    def union(self) -> None:
        self.eat("|") or self.eat("&")
        while True:
            self.type_operator()
            if not (self.eat("|") or self.eat("&")):
                return

    def type_operator(self) -> None:
        self.nest()
        if self.cur.k == "id" and self.cur.t in ("keyof", "unique", "readonly", "infer") and (self.ahead().k in ("id", "str", "num") or self.ahead().t in ("(", "[", "{")) and not self.ahead().nl:
            if self.next().t == "infer":
                self.name()
                if self.at("extends") and self.no_conditional:
                    self.quiet(self.infer_bound)
                self.depth -= 1
                return
            self.type_operator()
        elif self.function_type_follows():
            self.type_()
        else:
            self.type_primary()
            while not self.cur.nl and self.at("["):
                self.next()
                if not self.at("]"):
                    self.type_()
                self.need("]")
        self.depth -= 1

    def infer_bound(self) -> None:
        self.need("extends")
        self.type_()
        if self.at("?"):
            self.fail("a conditional type")

    def type_primary(self) -> None:
        t = self.cur
        if t.k in ("str", "num"):
            self.next()
        elif t.k == "tpl":
            self.next()
        elif t.t == "-" and self.ahead().k == "num":
            self.next()
            self.next()
        elif t.k == "op" and t.t == "(":
            self.next()
            old, self.no_conditional = self.no_conditional, False
            self.type_()
            self.no_conditional = old
            self.need(")")
        elif t.k == "op" and t.t == "[":
            self.next()
            while not self.at("]"):
                self.eat("...")
                if self.cur.k == "id" and (self.ahead().t == ":" or self.ahead().t == "?" and self.ahead(2).t == ":"):
                    self.next()
                    self.eat("?")
                    self.need(":")
                self.type_()
                self.eat("?")
                if not self.at("]"):
                    self.need(",")
            self.need("]")
        elif t.k == "op" and t.t == "{":
            self.object_type()
        elif t.k == "id" and t.t == "typeof":
            self.next()
            if self.at("import"):
                return self.type_primary()
            self.name(True)
            while self.eat("."):
                self.name(True)
            if self.at("<") and not self.cur.nl:
                self.type_args()
        elif t.k == "id" and t.t == "import":
            self.next()
            self.need("(")
            self.type_()
            self.need(")")
            while self.eat("."):
                self.name(True)
            if self.at("<"):
                self.type_args()
        elif t.k == "id" and (t.t not in _RESERVED or t.t in ("void", "null", "this", "true", "false")):
            self.next()
            while self.at(".") and not self.cur.nl:
                self.next()
                self.name(True)
            if self.at("<") and not self.cur.nl:
                self.type_args()
        else:
            self.fail("expected a type")
        return None

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type_()
        self.need("]")
        self.type_mark()

    def object_type(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",") or self.at("}") or self.cur.nl):
                self.fail("expected ';'")
        self.need("}")

    def type_member(self) -> None:
        if self.at("(", "<"):
            self.type_params()
            self.params()
            return self.type_mark(True)
        if self.at("new") and self.ahead().t in ("(", "<"):
            self.next()
            self.type_params()
            self.params()
            return self.type_mark(True)
        if self.at("+", "-"):
            self.next()
            self.need("readonly")
        elif self.at("readonly") and (self.ahead().k in ("id", "str", "num") or self.ahead().t == "["):
            self.next()
        if self.at("[") and self.ahead().k == "id" and self.ahead(2).t == ":":
            return self.index_signature()
        if self.at("[") and self.ahead().k == "id" and self.ahead(2).t == "in":
            self.next()
            self.next()
            self.next()
            self.type_()
            if self.eat("as"):
                self.type_()
            self.need("]")
            if self.at("+", "-"):
                self.next()
                self.need("?")
            else:
                self.eat("?")
            return self.type_mark()
        if self.at("get", "set") and self.ahead().k in ("id", "str"):
            self.next()
        self.property_name()
        self.eat("?")
        if self.at("(", "<"):
            self.type_params()
            self.params()
        self.type_mark(True)
        return None


def parse(text: str, errors: list, ts: bool) -> None:
    start = text.find("\n") if text.startswith("#!") else 0
    toks = tokens(text, "js", errors, max(start, 0) if start >= 0 else len(text))
    (Ts if ts else Js)(toks, len(text), errors).whole()
