"""A SPARQL 1.1 query parser that gives the algebra of :mod:`lexiloom.plans.algebra`.

It covers SELECT, ASK, CONSTRUCT and DESCRIBE with prefixes, triple patterns,
property paths, OPTIONAL, UNION, MINUS, GRAPH, FILTER, EXISTS, BIND, VALUES,
sub-selects, aggregates, HAVING and the solution modifiers. Prefixes of
``lexiloom.functions.terms.PREFIXES`` are declared without being written.
"""

from __future__ import annotations

import re
from dataclasses import replace

from lexiloom.functions.terms import PREFIXES, XSD, literal
from lexiloom.plans.algebra import (
    BGP, Call, Distinct, Exists, Extend, Filter, Graph, Group, Join, LeftJoin, Minus, OrderBy, Path, Project, Query, Slice, Triple, Union, Values, Var,
)

MAX_CHARS = 5000
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
UPDATES = {"INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD", "WITH"}


class QueryError(ValueError):
    """A refused query; ``kind`` is too-long, unsafe, update or parse."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<str>'''(?:(?:'|'')?[^'\\]|\\.)*'''|\"\"\"(?:(?:"|"")?[^"\\]|\\.)*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<var>[?$]\w+)
    |(?P<bnode>_:\w(?:[\w.-]*[\w-])?)
    |(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?)
    |(?P<qname>[A-Za-z][\w-]*:[\w][\w.%-]*(?<!\.)|[A-Za-z][\w-]*:|:[\w-]+)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!|/^*+?\-])""",
    re.X | re.S,
)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("parse", f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.toks, self.i = tokens(text), 0
        self.prefixes, self.base, self.fresh = dict(PREFIXES), "", 0
        self.dataset: list[tuple[bool, str]] = []

    # tokens
    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def word(self, *names: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in names

    def op(self, *ops: str) -> bool:
        kind, text = self.peek()
        return kind == "op" and text in ops

    def take(self) -> tuple[str, str]:
        tok = self.peek()
        if tok[0] == "end":
            raise QueryError("parse", "unexpected end")
        self.i += 1
        return tok

    def need(self, text: str) -> None:
        kind, got = self.take()
        if kind == "str" or got.upper() != text:
            raise QueryError("parse", f"expected {text}, found {got}")

    def new_var(self) -> Var:
        self.fresh += 1
        return Var(f"_b{self.fresh}")

    # query
    def query(self) -> Query:
        while self.word("PREFIX", "BASE"):
            if self.take()[1].upper() == "BASE":
                self.base = self.take()[1][1:-1]
            else:
                name = self.take()[1].rstrip(":")
                self.prefixes[name] = self.take()[1][1:-1]
        kind = self.peek()[1].upper()
        if kind == "SELECT":
            body = self.select()
            q = Query("select", body)
        elif kind == "ASK":
            self.take()
            self.where_word()
            q = Query("ask", self.group())
        elif kind == "CONSTRUCT":
            self.take()
            if self.op("{"):
                template = self.template()
                self.where_word()
                body = self.group()
            else:
                self.need("WHERE")
                body = self.group()
                template = body.triples if isinstance(body, BGP) else ()
            q = Query("construct", self.modifiers(body, None, ()), template)
        elif kind == "DESCRIBE":
            self.take()
            targets = []
            while not (self.word("WHERE") or self.op("{") or self.peek()[0] == "end"):
                targets.append(self.term())
            body = None
            if self.word("WHERE") or self.op("{"):
                self.where_word()
                body = self.group()
            q = Query("describe", body, targets=tuple(targets))
        else:
            raise QueryError("parse", f"a query can't begin with {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise QueryError("parse", f"unexpected {self.peek()[1]!r} after the query")
        return replace(q, dataset=tuple(self.dataset)) if self.dataset else q

    def where_word(self) -> None:
        while self.word("FROM"):
            self.take()
            named = self.word("NAMED")
            if named:
                self.take()
            self.dataset.append((named, self.term()))
        if self.word("WHERE"):
            self.take()

    def template(self) -> tuple[Triple, ...]:
        self.need("{")
        out: list[Triple] = []
        while not self.op("}"):
            self.triples(out)
            if self.op("."):
                self.take()
        self.take()
        return tuple(out)

    def select(self):
        self.need("SELECT")
        distinct = False
        if self.word("DISTINCT", "REDUCED"):
            distinct = self.take()[1].upper() == "DISTINCT"
        items: list[tuple[Var, object]] | None = []
        if self.op("*"):
            self.take()
            items = None
        else:
            while self.peek()[0] == "var" or self.op("("):
                if self.op("("):
                    self.take()
                    e = self.expression()
                    self.need("AS")
                    v = Var(self.take()[1][1:])
                    self.need(")")
                    items.append((v, e))
                else:
                    items.append((Var(self.take()[1][1:]), None))
        self.where_word()
        body = self.group()
        return self.modifiers(body, items, distinct)

    def modifiers(self, body, items, distinct):
        keys: list[tuple[Var, object]] = []
        grouped = False
        if self.word("GROUP"):
            self.take()
            self.need("BY")
            grouped = True
            while self.peek()[0] == "var" or self.op("("):
                if self.op("("):
                    self.take()
                    e = self.expression()
                    v = self.new_var()
                    if self.word("AS"):
                        self.take()
                        v = Var(self.take()[1][1:])
                    self.need(")")
                    keys.append((v, e))
                else:
                    keys.append((Var(self.take()[1][1:]), None))
        having = []
        if self.word("HAVING"):
            self.take()
            while self.op("("):
                having.append(self.bracketed())
        order = []
        if self.word("ORDER"):
            self.take()
            self.need("BY")
            while self.peek()[0] == "var" or self.op("(") or self.word("ASC", "DESC"):
                down = False
                if self.word("ASC", "DESC"):
                    down = self.take()[1].upper() == "DESC"
                    order.append((self.bracketed(), down))
                elif self.op("("):
                    order.append((self.bracketed(), down))
                else:
                    order.append((Var(self.take()[1][1:]), down))
        limit, offset = None, 0
        while self.word("LIMIT", "OFFSET"):
            which = self.take()[1].upper()
            n = int(self.take()[1])
            limit, offset = (n, offset) if which == "LIMIT" else (limit, n)
        aggregates: list[tuple[Var, Call]] = []

        def lift(e):
            """Aggregates inside an expression become columns of the group."""
            if isinstance(e, Call):
                if e.name in AGGREGATES:
                    for v, known in aggregates:
                        if known == e:
                            return v
                    v = self.new_var()
                    aggregates.append((v, e))
                    return v
                return Call(e.name, tuple(lift(a) for a in e.args), e.distinct)
            return e

        extends = [(v, lift(e)) for v, e in (items or []) if e is not None]
        conditions = [lift(e) for e in having]
        order = [(lift(e), d) for e, d in order]
        if grouped or aggregates:
            body = Group(body, tuple(keys), tuple(aggregates))
        for c in conditions:
            body = Filter(body, c)
        for v, e in extends:
            body = Extend(body, v, e)
        if order:
            body = OrderBy(body, tuple(order))
        if items is not None or distinct != ():
            body = Project(body, None if items is None else tuple(v for v, _ in items))
        if distinct:
            body = Distinct(body)
        if self.word("VALUES"):
            body = Join(body, self.values())
        if limit is not None or offset:
            body = Slice(body, limit, offset)
        return body

    # patterns
    def group(self):
        self.need("{")
        if self.word("SELECT"):
            body = self.select()
            self.need("}")
            return body
        body, filters, bgp = None, [], []

        def join(a, b):
            return b if a is None else Join(a, b)

        def flush():
            nonlocal body, bgp
            if bgp:
                body, bgp = join(body, BGP(tuple(bgp))), []

        while not self.op("}"):
            if self.word("OPTIONAL"):
                self.take()
                flush()
                inner = self.group()
                condition = None
                if isinstance(inner, Filter):
                    inner, condition = inner.child, inner.condition
                body = LeftJoin(body if body is not None else BGP(()), inner, condition)
            elif self.word("MINUS"):
                self.take()
                flush()
                body = Minus(body if body is not None else BGP(()), self.group())
            elif self.word("FILTER"):
                self.take()
                filters.append(self.constraint())
            elif self.word("BIND"):
                self.take()
                self.need("(")
                e = self.expression()
                self.need("AS")
                v = Var(self.take()[1][1:])
                self.need(")")
                flush()
                body = Extend(body if body is not None else BGP(()), v, e)
            elif self.word("VALUES"):
                flush()
                body = join(body, self.values())
            elif self.word("GRAPH"):
                self.take()
                name = self.term()
                flush()
                body = join(body, Graph(name, self.group()))
            elif self.word("SERVICE"):
                raise QueryError("unsafe", "SERVICE is not allowed")
            elif self.op("{"):
                flush()
                inner = self.group()
                while self.word("UNION"):
                    self.take()
                    inner = Union(inner, self.group())
                body = join(body, inner)
            else:
                self.triples(bgp)
            if self.op("."):
                self.take()
        self.take()
        flush()
        body = body if body is not None else BGP(())
        for f in filters:
            body = Filter(body, f)
        return body

    def values(self) -> Values:
        self.need("VALUES")
        if self.op("("):
            self.take()
            names = []
            while not self.op(")"):
                names.append(Var(self.take()[1][1:]))
            self.take()
            many = True
        else:
            names, many = [Var(self.take()[1][1:])], False
        self.need("{")
        rows = []
        while not self.op("}"):
            if many:
                self.need("(")
            row = []
            while not (self.op(")") or (not many and row)):
                if self.word("UNDEF"):
                    self.take()
                    row.append(None)
                else:
                    row.append(self.term())
            if many:
                self.need(")")
            rows.append(tuple(row))
        self.take()
        return Values(tuple(names), tuple(rows))

    def triples(self, out: list[Triple]) -> None:
        subject = self.node(out)
        if self.op(".") or self.op("}"):
            return
        self.properties(subject, out)

    def properties(self, subject, out: list[Triple]) -> None:
        while True:
            verb = self.path()
            while True:
                out.append(Triple(subject, verb, self.node(out)))
                if not self.op(","):
                    break
                self.take()
            if not self.op(";"):
                return
            while self.op(";"):
                self.take()
            if self.op(".", "}", "]"):
                return

    def node(self, out: list[Triple]):
        if self.op("["):
            self.take()
            v = self.new_var()
            if not self.op("]"):
                self.properties(v, out)
            self.need("]")
            return v
        return self.term()

    def path(self):
        if self.peek()[0] == "var":
            return Var(self.take()[1][1:])
        p = self.path_alternative()
        return p.args[0] if p.op == "iri" else p

    def path_alternative(self) -> Path:
        parts = [self.path_sequence()]
        while self.op("|"):
            self.take()
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_sequence(self) -> Path:
        parts = [self.path_step()]
        while self.op("/"):
            self.take()
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def negated(self):
        """A member of a negated set: an IRI, or the inverse of one."""
        if self.op("^"):
            self.take()
            return Path("inv", (self.term(),))
        return self.term()

    def path_step(self) -> Path:
        if self.op("^"):
            self.take()
            return Path("inv", (self.path_step(),))
        if self.op("!"):
            self.take()
            if self.op("("):
                self.take()
                names = [self.negated()]
                while self.op("|"):
                    self.take()
                    names.append(self.negated())
                self.need(")")
            else:
                names = [self.negated()]
            return Path("not", tuple(names))
        if self.op("("):
            self.take()
            p = self.path_alternative()
            self.need(")")
        else:
            p = Path("iri", (self.term(),))
        while self.op("+", "*", "?"):
            p = Path({"+": "plus", "*": "star", "?": "opt"}[self.take()[1]], (p,))
        return p

    def term(self):
        kind, text = self.take()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return f"<{self.base}{text[1:-1]}>" if self.base and ":" not in text else text
        if kind == "qname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise QueryError("parse", f"unknown prefix {prefix}")
            return f"<{self.prefixes[prefix]}{local}>"
        if kind == "bnode":
            return Var("_n" + text[2:])
        if kind == "word" and text == "a":
            return f"<{PREFIXES['rdf']}type>"
        if kind == "word" and text.lower() in ("true", "false"):
            return literal(text.lower(), datatype=f"{XSD}boolean")
        if kind == "num" or (kind == "op" and text in "+-" and self.peek()[0] == "num"):
            if kind == "op":
                text = (text if text == "-" else "") + self.take()[1]
            kind_ = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return literal(text, datatype=XSD + kind_)
        if kind == "str":
            quote = 3 if text[:3] in ("'''", '"""') else 1
            body = text[quote:-quote]
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
            if self.peek()[0] == "lang":
                return literal(body, lang=self.take()[1][1:])
            if self.op("^^"):
                self.take()
                return literal(body, datatype=self.term()[1:-1])
            return literal(body)
        raise QueryError("parse", f"unexpected {text!r}")

    # expressions
    def constraint(self):
        if self.word("NOT", "EXISTS"):
            return self.exists()
        if self.op("("):
            return self.bracketed()
        return self.primary()

    def exists(self):
        negated = self.take()[1].upper() == "NOT"
        if negated:
            self.need("EXISTS")
        return Exists(self.group(), negated)

    def bracketed(self):
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def expression(self):
        e = self.conjunction()
        while self.op("||"):
            self.take()
            e = Call("or", (e, self.conjunction()))
        return e

    def conjunction(self):
        e = self.relation()
        while self.op("&&"):
            self.take()
            e = Call("and", (e, self.relation()))
        return e

    def relation(self):
        e = self.sum()
        if self.op("=", "!=", "<", ">", "<=", ">="):
            return Call(self.take()[1], (e, self.sum()))
        if self.word("IN", "NOT"):
            negated = self.take()[1].upper() == "NOT"
            if negated:
                self.need("IN")
            self.need("(")
            items = []
            while not self.op(")"):
                items.append(self.expression())
                if self.op(","):
                    self.take()
            self.take()
            found = Call("in", (e, *items))
            return Call("not", (found,)) if negated else found
        return e

    def sum(self):
        e = self.product()
        while self.op("+", "-"):
            e = Call(self.take()[1], (e, self.product()))
        return e

    def product(self):
        e = self.unary()
        while self.op("*", "/"):
            e = Call(self.take()[1], (e, self.unary()))
        return e

    def unary(self):
        if self.op("!"):
            self.take()
            return Call("not", (self.unary(),))
        if self.op("-") and self.peek(1)[0] != "num":
            self.take()
            return Call("neg", (self.unary(),))
        return self.primary()

    def primary(self):
        if self.op("("):
            return self.bracketed()
        if self.word("NOT", "EXISTS"):
            return self.exists()
        kind, text = self.peek()
        after = self.peek(1)
        if kind == "word" and after == ("op", "("):
            name = self.take()[1].upper()
            self.take()
            distinct = False
            if self.word("DISTINCT"):
                self.take()
                distinct = True
            args = []
            while not self.op(")"):
                if self.op("*"):
                    self.take()
                    continue
                if self.op(";"):  # GROUP_CONCAT(... ; SEPARATOR = "x")
                    self.take()
                    self.need("SEPARATOR")
                    self.need("=")
                    args.append(self.term())
                    continue
                args.append(self.expression())
                if self.op(","):
                    self.take()
            self.take()
            return Call(name, tuple(args), distinct)
        if kind in ("iri", "qname") and after == ("op", "("):
            name = self.term()
            self.take()
            args = []
            while not self.op(")"):
                args.append(self.expression())
                if self.op(","):
                    self.take()
            self.take()
            return Call(name, tuple(args))
        if kind == "qname" and text.endswith(":"):
            self.take()
            return f"<{self.prefixes[text[:-1]]}>"
        return self.term()


def parse(text: str) -> Query:
    """The algebra of a query; refusals are :class:`QueryError` of four kinds."""
    if len(text) > MAX_CHARS:
        raise QueryError("too-long", f"a query has at most {MAX_CHARS} characters")
    toks = tokens(text)
    first = next((t for k, t in toks if k == "word" and t.upper() not in ("PREFIX", "BASE")), "")
    if first.upper() in UPDATES:
        raise QueryError("update", "only read queries are allowed")
    try:
        return Parser(text).query()
    except (IndexError, KeyError, ValueError) as e:
        if isinstance(e, QueryError):
            raise
        raise QueryError("parse", str(e)) from e
