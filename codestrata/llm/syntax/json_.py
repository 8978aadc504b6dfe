"""JSON (RFC 8259)."""

from __future__ import annotations

import re

from codestrata.llm.syntax.base import EOF, Parser, Tok

_TOKEN = re.compile(
    r'[ \t\r\n]+|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<id>(?:true|false|null)\b)|(?P<op>[{}\[\]:,])|(?P<bad>"[^"\n]*"?|[^\s{}\[\]:,"]+|.)',
    re.S,
)


class Json(Parser):
    def whole(self) -> None:
        if self.cur.k == EOF:
            self.errors.append((self.cur.p, "empty"))
            return
        start = self.i
        try:
            self.value()
        except Exception as e:  # Bail
            if type(e).__name__ != "Bail":
                raise
            self.recover(start, None)
            self.statements(self.value, None)
            return
        if self.cur.k != EOF:
            self.errors.append((self.cur.p, f"unexpected {self.cur.t[:30]!r}"))

    def value(self) -> None:
        self.nest()
        t = self.next()
        if t.k in ("str", "num", "id"):
            pass
        elif t.t == "{" and t.k == "op":
            if not self.eat("}"):
                while True:
                    if self.cur.k != "str":
                        self.fail("expected a key")
                    self.next()
                    self.need(":")
                    self.value()
                    if self.eat("}"):
                        break
                    self.need(",")
        elif t.t == "[" and t.k == "op":
            if not self.eat("]"):
                while True:
                    self.value()
                    if self.eat("]"):
                        break
                    self.need(",")
        else:
            if t.k != EOF:
                self.seek(self.i - 1)
            self.fail("expected a value")
        self.depth -= 1


def parse(text: str, errors: list) -> None:
    toks = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup:
            if m.lastgroup == "bad":
                errors.append((m.start(), f"no JSON token: {m[0][:30]!r}"))
            toks.append(Tok(m.lastgroup, m[0], m.start()))
    Json(toks, len(text), errors).whole()
