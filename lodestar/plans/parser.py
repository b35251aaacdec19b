"""Parser of queries, groupings, metrics, field sets and sort orders: recursive descent over the text. Keywords are upper-case."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from ..functions import times
from .ast import And, Binary, Clause, Count, Everything, Group, Metric, Not, Nothing, Number, Or, Output, PathSets, Range, Step

_NAME = re.compile(r"[A-Za-z_#@$][\w#@]*(?:-[\w#@]+)*")
_VALUE = re.compile(r"[^\s()\[\]{},=<>:\"']+")
_ZONE = re.compile(r"[\w/+:-]+")
_ESC = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
DATE_PARTS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")


class DQLError(ValueError):
    pass


class Parser:
    def __init__(self, text: str, clock: datetime | None = None, aliases: dict[str, str] | None = None):
        for name in sorted(aliases or {}, key=len, reverse=True):
            text = text.replace(name, aliases[name])
        self.s, self.i, self.clock = text, 0, clock or datetime.now(UTC).replace(tzinfo=None)

    # -- characters

    def space(self):
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def peek(self, text: str) -> bool:
        self.space()
        if not self.s.startswith(text, self.i):
            return False
        end = self.i + len(text)
        return not (text[-1].isalnum() and end < len(self.s) and (self.s[end].isalnum() or self.s[end] == "_"))

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.i += len(text)
            return True
        return False

    def need(self, text: str):
        if not self.take(text):
            raise DQLError(f"expected {text!r} at {self.i} in {self.s!r}")

    def match(self, pattern: re.Pattern):
        self.space()
        if m := pattern.match(self.s, self.i):
            self.i = m.end()
            return m[0]
        return None

    def name(self) -> str:
        if (n := self.match(_NAME)) is None:
            raise DQLError(f"expected a name at {self.i} in {self.s!r}")
        return n

    def done(self):
        self.space()
        if self.i < len(self.s):
            raise DQLError(f"unexpected text at {self.i} in {self.s!r}")

    def inside(self) -> str:
        """The raw text up to the matching parenthesis."""
        self.need("(")
        depth, start = 1, self.i
        while self.i < len(self.s) and depth:
            depth += {"(": 1, ")": -1}.get(self.s[self.i], 0)
            self.i += 1
        if depth:
            raise DQLError(f"no closing parenthesis in {self.s!r}")
        return self.s[start : self.i - 1]

    def quoted(self) -> str | None:
        self.space()
        if self.i >= len(self.s) or self.s[self.i] not in "'\"":
            return None
        q, out = self.s[self.i], []
        self.i += 1
        while self.i < len(self.s) and self.s[self.i] != q:
            c = self.s[self.i]
            if c == "\\" and self.i + 1 < len(self.s):
                self.i += 1
                c = self.s[self.i]
                if c == "u":
                    c = chr(int(self.s[self.i + 1 : self.i + 5], 16))
                    self.i += 4
                else:
                    c = _ESC.get(c, c)
            out.append(c)
            self.i += 1
        if self.i >= len(self.s):
            raise DQLError(f"no closing quote in {self.s!r}")
        self.i += 1
        return "".join(out)

    def value(self) -> str:
        if (q := self.quoted()) is not None:
            return q
        if self.peek("NOW") and re.match(r"\s*NOW\s*\(", self.s[self.i :]):
            self.take("NOW")
            return times.now(self.inside(), self.clock).isoformat(sep=" ")
        if (v := self.match(_VALUE)) is None:
            raise DQLError(f"expected a value at {self.i} in {self.s!r}")
        return v

    # -- queries

    def query(self):
        self.space()
        if self.i == len(self.s):
            return Nothing()
        q = self.either()
        self.done()
        return q

    def either(self):
        parts = [self.both()]
        while self.take("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.negated()]
        while True:
            self.space()
            if self.i >= len(self.s) or self.s[self.i] in "),":
                break
            if self.peek("OR") or self.peek("AS"):
                break
            self.take("AND")
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negated(self):
        if self.take("NOT") or self.take("-"):
            return Not(self.negated())
        return self.primary()

    def primary(self):
        if self.take("("):
            q = self.either()
            self.need(")")
            return q
        if self.peek("WHERE") and re.match(r"WHERE\s*\(", self.s[self.i :]):
            self.take("WHERE")
            self.need("(")
            q = self.either()
            self.need(")")
            return And((q, self.primary())) if self.take(".") else q
        for word, distinct in (("COUNT", False), ("DCOUNT", True)):
            if re.match(rf"\s*{word}\s*\(", self.s[self.i :]):
                self.take(word)
                self.need("(")
                steps = self.path()
                self.need(")")
                return Count(steps, self.number_test(), distinct)
        for kind in ("EQUALS", "DIFFERS", "INTERSECTS", "CONTAINS", "DISJOINT"):
            if re.match(rf"\s*{kind}\s*\(", self.s[self.i :]):
                self.take(kind)
                self.need("(")
                a = self.path()
                self.need(",")
                b = self.path()
                self.need(")")
                return PathSets(kind, a, b)
        if self.take("*"):
            for op in ":=":
                if self.take(op):
                    return Clause((), op, self.value())
            return Everything()
        if (q := self.quoted()) is not None:
            return Clause((), ":", q)
        start = self.i
        if re.match(r"\s*(?:[A-Za-z_#@$][\w#@-]*)(?:\s*(?:[=:<>.^(]|IN\b|IS\b))", self.s[self.i :]):
            return self.clause()
        self.i = start
        return Clause((), ":", self.value())

    def path(self, quant: str = "ANY") -> tuple:
        steps: list[Step] = []
        while True:
            for q in ("ANY", "ALL", "NONE"):
                if re.match(rf"\s*{q}\s*\(", self.s[self.i :]):
                    self.take(q)
                    self.need("(")
                    inner = self.path(q)
                    self.need(")")
                    steps += inner
                    break
            else:
                if re.match(r"\s*WHERE\s*\(", self.s[self.i :]):
                    self.take("WHERE")
                    self.need("(")
                    where = self.either()
                    self.need(")")
                    if steps:
                        steps[-1] = Step(steps[-1].name, steps[-1].quant, (*steps[-1].where, where), steps[-1].depth)
                    else:
                        steps.append(Step("", where=(where,)))
                else:
                    n, depth = self.name() if not self.take("*") else "*", 0
                    if self.take("^"):
                        depth = int(self.inside()) if self.peek("(") else -1
                    # NONE holds for the first link, ANY for those after it
                    steps.append(Step(n, quant if quant != "NONE" or not steps else "ANY", (), depth))
            if not self.take("."):
                return tuple(steps)

    def clause(self):
        steps = self.path()
        if self.take("IS"):
            self.need("NULL")
            return Clause(steps, "null")
        if self.take("IN"):
            if self.peek("("):
                return Clause(steps, "in", self.values())
            return Clause(steps, "=", self.value())
        for text, r in (("<=", lambda v: Range(high=v)), (">=", lambda v: Range(low=v)), ("<", lambda v: Range(high=v, high_in=False)), (">", lambda v: Range(low=v, low_in=False))):
            if self.take(text):
                return Clause(steps, "range", r(self.value()))
        op = "=" if self.take("=") else ":" if self.take(":") else None
        if op is None:
            if steps[-1].where:
                return Clause((*steps, Step("*")), "exists")
            raise DQLError(f"expected an operator at {self.i} in {self.s!r}")
        if self.peek("["):
            return Clause(steps, "range", self.range())
        if self.peek("{"):
            return Clause(steps, "range", self.range())
        if self.peek("("):
            return Clause(steps, "in" if op == "=" else "any:", self.values())
        if self.take("NULL"):
            return Clause(steps, "null")
        if re.match(r"\s*PERIOD\s*\(", self.s[self.i :]):
            self.take("PERIOD")
            z = self.inside().strip()
            self.need(".")
            name = self.name()
            n = int(self.inside()) if self.peek("(") else 1
            a, b, closed = times.period(name, z, self.clock, n)
            return Clause(steps, "range", Range(a.isoformat(sep=" "), True, b.isoformat(sep=" "), closed))
        v = self.value()
        return Not(Clause(steps, "null")) if v == "*" else Clause(steps, op, v)

    def values(self) -> tuple:
        self.need("(")
        out = [self.value()]
        while self.take(",") or self.take("OR") or not self.peek(")"):
            out.append(self.value())
        self.need(")")
        return tuple(out)

    def range(self) -> Range:
        low_in = self.take("[") or not self.take("{")
        low = self.value()
        self.need("TO")
        high = self.value()
        high_in = self.take("]")
        if not high_in:
            self.need("}")
        return Range(None if low == "*" else low, low_in, None if high == "*" else high, high_in)

    def number_test(self) -> Range:
        for text, r in (("<=", lambda v: Range(high=v)), (">=", lambda v: Range(low=v)), ("<", lambda v: Range(high=v, high_in=False)), (">", lambda v: Range(low=v, low_in=False))):
            if self.take(text):
                return r(self.value())
        if not self.take("="):
            self.need(":")
        if self.peek("[") or self.peek("{"):
            return self.range()
        v = self.value()
        return Range(v, True, v, True)

    # -- groupings

    def group_sets(self) -> list[list[Group]]:
        if not re.match(r"\s*GROUP\s*\(", self.s):
            out = [self.groups()]
            self.done()
            return out
        out = []
        while True:
            self.need("GROUP")
            self.need("(")
            out.append([] if self.take("*") else self.groups())
            self.need(")")
            if not self.take(","):
                break
        self.done()
        return out

    def groups(self) -> list[Group]:
        out = [self.group()]
        while self.take(","):
            out.append(self.group())
        return out

    def group(self) -> Group:
        for pick in ("TOP", "BOTTOM", "FIRST", "LAST"):
            if re.match(rf"\s*{pick}\s*\(", self.s[self.i :]):
                self.take(pick)
                self.need("(")
                n = int(self.value())
                self.need(",")
                g = self.group()
                self.need(")")
                return self.alias(Group(g.steps, g.func, g.args, g.where, pick, n, g.include, g.exclude, g.alias))
        for func in ("BATCH", "TRUNCATE", "TERMS", "UPPER", "LOWER", "SETS"):
            if not re.match(rf"\s*{func}\s*\(", self.s[self.i :]):
                continue
            self.take(func)
            self.need("(")
            if func == "SETS":
                args = []
                while True:
                    start = self.i
                    q = self.either()
                    text = self.s[start : self.i].strip()
                    args.append((q, (self.quoted() or self.name()) if self.take("AS") else text))
                    if not self.take(","):
                        break
                self.need(")")
                return self.alias(Group((), func, tuple(args)))
            g, args = self.plain(), []
            while self.take(","):
                args.append(self.values() if self.peek("(") else (self.quoted() or self.match(_ZONE)) if func == "TRUNCATE" else self.value())
            self.need(")")
            return self.alias(Group(g.steps, func, tuple(args), g.where, include=g.include, exclude=g.exclude))
        return self.alias(self.plain())

    def plain(self) -> Group:
        where, steps, include, exclude, alias = [], [], [], [], None
        while True:
            if re.match(r"\s*(INCLUDE|EXCLUDE)\s*\(", self.s[self.i :]):
                into = include if self.take("INCLUDE") else exclude
                if into is exclude:
                    self.need("EXCLUDE")
                into += self.values()
            elif re.match(r"\s*AS\s*\(", self.s[self.i :]):
                self.take("AS")
                alias = self.inside().strip()
            else:
                for s in self.one_step():
                    if s.name:
                        steps.append(s)
                    elif steps:
                        steps[-1] = Step(steps[-1].name, steps[-1].quant, (*steps[-1].where, *s.where), steps[-1].depth)
                    else:
                        where += s.where
            if not self.take("."):
                return Group(tuple(steps), None, (), tuple(where), include=tuple(include), exclude=tuple(exclude), alias=alias)

    def one_step(self) -> list[Step]:
        if re.match(r"\s*WHERE\s*\(", self.s[self.i :]):
            self.take("WHERE")
            self.need("(")
            q = self.either()
            self.need(")")
            return [Step("", where=(q,))]
        n, depth = self.name() if not self.take("*") else "*", 0
        if self.take("^"):
            depth = int(self.inside()) if self.peek("(") else -1
        return [Step(n, depth=depth)]

    def alias(self, g: Group) -> Group:
        if self.take("AS"):
            return Group(g.steps, g.func, g.args, g.where, g.pick, g.n, g.include, g.exclude, self.quoted() or self.name())
        return g

    # -- metrics

    def metrics(self) -> list[tuple[object, str]]:
        out = []
        while True:
            start = self.i
            m = self.sum()
            text = self.s[start : self.i].strip()
            out.append((m, (self.quoted() or self.name()) if self.take("AS") else text))
            if not self.take(","):
                break
        self.done()
        return out

    def sum(self):
        a = self.product()
        while True:
            op = next((o for o in "+-" if self.take(o)), None)
            if op is None:
                return a
            a = Binary(op, a, self.product())

    def product(self):
        a = self.metric()
        while True:
            op = next((o for o in "*/" if self.take(o)), None)
            if op is None:
                return a
            a = Binary(op, a, self.metric())

    def metric(self):
        if self.take("("):
            m = self.sum()
            self.need(")")
            return m
        if n := self.match(re.compile(r"\d+(?:\.\d+)?")):
            return Number(float(n))
        func = self.name()
        self.need("(")
        if func == "DATEDIFF":
            unit = self.name()
            self.need(",")
            a = self.value()
            self.need(",")
            b = self.value()
            self.need(")")
            return Number(float(times.datediff(unit, times.parse(a), times.parse(b))))
        if func not in ("COUNT", "SUM", "MIN", "MAX", "AVERAGE", "DISTINCT", "MINCOUNT", "MAXCOUNT"):
            raise DQLError(f"unknown metric {func}")
        roundup = None
        if self.take("ROUNDUP"):
            self.need("(")
            g = self.plain()
            self.need(",")
            roundup = float(self.value())
            self.need(")")
        else:
            g = self.plain()
        self.need(")")
        return Metric(func, g.steps, g.where, roundup)

    # -- field sets and orders

    def outputs(self) -> tuple:
        out = []
        while True:
            out.append(self.output())
            if not self.take(","):
                return tuple(out)

    def output(self) -> Output:
        n = "*" if self.take("*") else self.name()
        limit, where, inner, alias = None, [], (), None
        while True:
            if self.take("["):
                limit = int(self.value())
                self.need("]")
            elif self.take("("):
                inner = self.outputs()
                self.need(")")
            elif self.take("."):
                if re.match(r"WHERE\s*\(", self.s[self.i :]):
                    self.take("WHERE")
                    self.need("(")
                    where.append(self.either())
                    self.need(")")
                elif re.match(r"AS\s*\(", self.s[self.i :]):
                    self.take("AS")
                    alias = self.inside().strip()
                else:
                    inner = (*inner, self.output())
            elif self.take("AS"):
                alias = self.quoted() or self.name()
            else:
                return Output(n, limit, tuple(where), inner, alias)

    def orders(self) -> list[tuple[tuple, bool]]:
        out = []
        while True:
            steps = self.path()
            down = self.take("DESC")
            if not down:
                self.take("ASC")
            out.append((steps, down))
            if not self.take(","):
                self.done()
                return out
