"""Token stream, error list and panic-mode recovery shared by all parsers."""

from __future__ import annotations

from bisect import bisect_right

EOF = "eof"
OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {")", "]", "}"}


class Bail(Exception):
    """Leaves the statement at hand; the error is already stored."""


class Tok:
    __slots__ = ("k", "t", "p", "nl", "sub")

    def __init__(self, k, t, p, nl=False, sub=None):
        self.k, self.t, self.p, self.nl, self.sub = k, t, p, nl, sub

    def __repr__(self):
        return f"{self.k}:{self.t}"


class Lines:
    """Maps positions to line numbers."""

    def __init__(self, text: str):
        self.starts = [0]
        i = text.find("\n")
        while i >= 0:
            self.starts.append(i + 1)
            i = text.find("\n", i + 1)

    def of(self, pos: int) -> int:
        return bisect_right(self.starts, pos)


class Parser:
    """Statements by recursive descent, binary expressions by precedence climbing."""

    #: Names that begin a statement; recovery stops before them.
    STARTERS: frozenset = frozenset()
    #: Binary operators by precedence.
    BINARY: dict = {}

    def __init__(self, toks: list[Tok], end: int, errors: list):
        self.toks, self.errors, self.i, self.depth = toks, errors, 0, 0
        self.toks.append(Tok(EOF, "", end, True))
        self.cur = self.toks[0]
        self.partner = self._partners()

    def _partners(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.toks):
            if t.k == "op":
                if t.t in OPEN:
                    stack.append(i)
                elif t.t in CLOSE and stack and OPEN[self.toks[stack[-1]].t] == t.t:
                    out[stack.pop()] = i
        return out

    # -- stream
    def seek(self, i: int) -> None:
        self.i, self.cur = i, self.toks[i]

    def next(self) -> Tok:
        t = self.cur
        if t.k != EOF:
            self.i += 1
            self.cur = self.toks[self.i]
        return t

    def ahead(self, n: int = 1) -> Tok:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        return self.cur.t in texts and self.cur.k in ("op", "id")

    def eat(self, text: str) -> bool:
        if self.cur.t == text and self.cur.k in ("op", "id"):
            self.next()
            return True
        return False

    def need(self, text: str) -> Tok:
        if self.cur.t == text and self.cur.k in ("op", "id"):
            return self.next()
        self.fail(f"expected {text!r}")

    def fail(self, why: str):
        t = self.cur
        self.errors.append((t.p, f"{why}, found {'the end' if t.k == EOF else repr(t.t[:30])}"))
        raise Bail

    def quiet(self, f, *args):
        """Tries a reading; on failure returns None at the old place with no error stored."""
        i, n, d = self.i, len(self.errors), self.depth
        try:
            out = f(*args)
            if len(self.errors) == n:
                return out if out is not None else True
        except Bail:
            pass
        del self.errors[n:]
        self.depth = d
        self.seek(i)
        return None

    # -- recovery
    def statements(self, one, until: str | None) -> None:
        """Statements up to a closing token; after an error, skips to a likely statement start and goes on."""
        while self.cur.k != EOF and not (until and self.cur.t == until and self.cur.k == "op"):
            start, depth = self.i, self.depth
            try:
                self.nest()
                one()
            except Bail:
                self.depth = depth
                self.recover(start, until)
            else:
                self.depth = depth
                if self.i == start:
                    self.errors.append((self.cur.p, f"unexpected {self.cur.t[:30]!r}"))
                    self.next()

    def recover(self, start: int, until: str | None) -> None:
        if self.i == start:
            self.next()
        while self.cur.k != EOF:
            t = self.cur
            if t.k == "op" and t.t == ";":
                self.next()
                return
            if t.k == "op" and t.t == "}":
                if until == "}":
                    return
                self.next()
                return
            if t.k == "op" and t.t in OPEN and self.i in self.partner:
                self.seek(self.partner[self.i])
                self.next()
                continue
            if t.k == "id" and t.nl and t.t in self.STARTERS:
                return
            self.next()

    def nest(self) -> None:
        self.depth += 1

    # -- expressions
    def binary(self, least: int = 1) -> str:
        self.nest()
        left = self.unary()
        while True:
            p = self.BINARY.get(self.cur.t) if self.cur.k in ("op", "id") else None
            if p is None or p < least or not self.allow_binary():
                break
            op = self.next().t
            left = self.binary_rest(op, p)
        self.depth -= 1
        return left

    def binary_rest(self, op: str, p: int) -> str:
        self.binary(p + 1)
        return "value"

    def allow_binary(self) -> bool:
        return True

    def unary(self) -> str:
        raise NotImplementedError
