"""A small SQL dialect over telemetry tables, compiled to DataFrames.

One SELECT over ``metrics``, ``spans``, ``logs``, ``deployments`` or ``incidents`` (or whatever tables the session is
given), with WHERE, GROUP BY, TUMBLE / HOP windows, COUNT, SUM, AVG, MIN, MAX, P50, P95, P99, at most one
``JOIN deployments ON service = service`` on the time interval, and ORDER BY with LIMIT. What isn't in the dialect is
refused by name, not passed over. Predicates have SQL's three-valued meaning, LIKE is SQL's, windows hop as they should.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarp.functions.compare import ratio
from tracewarp.functions.ddsketch import quantiles, sketch
from tracewarp.functions.eventtime import UNIT_NS, hop_starts, tumble_start
from tracewarp.operators.joins import change_join, counted_join

LOOKBACK_NS, LOOKAHEAD_NS = 5_000_000_000, 10_000_000_000
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
AGGREGATES = {"count", "sum", "avg", "min", "max", *QUANTILES}
#: How many rows a row of a counted join stands for.
COUNT = "__n"
JOINED = ("change_id", "change_type", "version_after", "delay_ns")
#: Columns of the standing tables; a session may give others.
CATALOG: dict[str, str] = {
    "metrics": "service string, name string, value double, event_time long",
    "spans": "service string, operation string, duration_ns long, status string, trace_id string, event_time long",
    "logs": "service string, severity string, body string, event_time long",
    "deployments": "service string, change_id string, change_type string, version_after string, event_time long",
    "incidents": "incident_id string, start_time long, end_time long",
}
_TOKEN = re.compile(r"\s*(?:(--[^\n]*)|('(?:[^']|'')*')|(\d+\.\d*|\.\d+|\d+)|([A-Za-z_][A-Za-z_0-9]*)|(<>|!=|<=|>=|[-+*/=<>(),.;]))")
_REFUSED = {"with": "WITH", "union": "UNION", "intersect": "INTERSECT", "except": "EXCEPT", "having": "HAVING", "offset": "OFFSET", "over": "OVER", "filter": "FILTER", "fetch": "FETCH", "window": "WINDOW", "qualify": "QUALIFY"}
_CLAUSES = {"select", "from", "where", "group", "order", "limit", "join", "inner", "left", "on", "by", "as", "and", "or", "not", "like", "asc", "desc", "is", "in", "between", "distinct", *_REFUSED}


class DialectError(ValueError):
    """The statement isn't in the dialect, or names what isn't there."""


@dataclass(frozen=True)
class Node:
    """An expression: ``kind`` with ``args``; columns and literals have a ``value``."""

    kind: str
    args: tuple[Node, ...] = ()
    value: object = None

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()


@dataclass
class Statement:
    items: list[tuple[str, Node]] = field(default_factory=list)
    table: str = ""
    join: str | None = None
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    grouped: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


class _Parser:
    def __init__(self, sql: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while sql[at:].strip():
            m = _TOKEN.match(sql, at)
            if not m:
                raise DialectError(f"can't read {sql[at : at + 20].strip()!r}")
            at = m.end()
            kinds = ("comment", "string", "number", "name", "sign")
            kind = next(k for k, g in zip(kinds, m.groups()) if g is not None)
            if kind != "comment":
                self.toks.append((kind, m.group(m.lastindex)))
        self.i = 0

    def peek(self, n: int = 0) -> str:
        t = self.toks[self.i + n] if self.i + n < len(self.toks) else ("end", "")
        return t[1].lower() if t[0] in ("name", "sign") else ""

    def take(self, *words: str) -> bool:
        if self.peek() and self.peek() in words:
            self.i += 1
            return True
        if self.peek() in _REFUSED:
            raise DialectError(f"{_REFUSED[self.peek()]} isn't in the dialect")
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise DialectError(f"expected {word.upper()} before {self.rest()!r}")

    def rest(self) -> str:
        return " ".join(t[1] for t in self.toks[self.i : self.i + 4])

    def name(self) -> str:
        kind, text = self.toks[self.i] if self.i < len(self.toks) else ("end", "")
        if kind != "name" or text.lower() in _CLAUSES:
            if text.lower() in _REFUSED:
                raise DialectError(f"{_REFUSED[text.lower()]} isn't in the dialect")
            raise DialectError(f"expected a name before {self.rest()!r}")
        self.i += 1
        return text

    def statement(self) -> Statement:
        s = Statement()
        self.need("select")
        if self.take("distinct"):
            raise DialectError("SELECT DISTINCT isn't in the dialect")
        while True:
            if self.peek() == "*":
                raise DialectError("wildcard projections aren't in the dialect")
            e = self.expression()
            alias = self.name() if self.take("as") else self.name() if self.peek() and re.match("[a-z_]", self.peek()) and self.peek() not in _CLAUSES else self.title(e, len(s.items))
            s.items.append((alias, e))
            if not self.take(","):
                break
        self.need("from")
        s.table = self.name().lower()
        if self.take(","):
            raise DialectError("several tables in FROM aren't in the dialect")
        how = "left" if self.take("left") else "inner" if self.take("inner") else None
        if self.take("join"):
            if self.name().lower() != "deployments":
                raise DialectError("only deployments can be joined")
            self.need("on")
            sides = self.column(), self.need("="), self.column()
            if {sides[0].value, sides[2].value} != {"service"}:
                raise DialectError("the join must be ON service = service")
            s.join = how or "inner"
            if self.peek() in ("join", "inner", "left"):
                raise DialectError("only one join is in the dialect")
        elif how:
            raise DialectError("expected JOIN")
        if self.take("where"):
            s.where = self.expression()
        if self.take("group"):
            self.need("by")
            s.grouped = True
            while True:
                s.group.append(self.expression())
                if not self.take(","):
                    break
        if self.take("order"):
            self.need("by")
            while True:
                c = self.name().lower()
                down = self.take("desc")
                if not down:
                    self.take("asc")
                if self.peek() == "nulls":
                    raise DialectError("NULLS FIRST and NULLS LAST aren't in the dialect")
                s.order.append((c, down))
                if not self.take(","):
                    break
        if self.take("limit"):
            kind, text = self.toks[self.i] if self.i < len(self.toks) else ("end", "")
            if kind != "number" or not text.isdigit():
                raise DialectError("LIMIT needs a whole number")
            s.limit, self.i = int(text), self.i + 1
        self.take(";")
        if self.i < len(self.toks):
            raise DialectError(f"only one statement, and nothing after it: {self.rest()!r}")
        if s.order and s.limit is None:
            raise DialectError("ORDER BY needs a LIMIT")
        return s

    @staticmethod
    def title(e: Node, n: int) -> str:
        if e.kind == "column":
            return str(e.value)
        return "window_start" if e.kind in ("tumble", "hop") else e.kind if e.kind in AGGREGATES else f"expr_{n + 1}"

    def column(self) -> Node:
        n = self.name()
        if self.take("."):
            n = self.name()
        return Node("column", value=n.lower())

    def expression(self) -> Node:
        e = self.conjunction()
        while self.take("or"):
            e = Node("or", (e, self.conjunction()))
        return e

    def conjunction(self) -> Node:
        e = self.negation()
        while self.take("and"):
            e = Node("and", (e, self.negation()))
        return e

    def negation(self) -> Node:
        return Node("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        e = self.sum()
        op = self.peek()
        if op in ("=", "<>", "!=", "<", "<=", ">", ">="):
            self.i += 1
            return Node("<>" if op == "!=" else op, (e, self.sum()))
        inverted = op == "not" and self.peek(1) == "like"
        if inverted:
            self.i += 1
        if self.take("like"):
            like = Node("like", (e, self.sum()))
            if like.args[1].kind != "text":
                raise DialectError("LIKE needs a text")
            return Node("not", (like,)) if inverted else like
        if op == "in" or op == "not" and self.peek(1) == "in":
            raise DialectError("IN isn't in the dialect")
        if op in ("is", "between"):
            raise DialectError(f"{op.upper()} isn't in the dialect")
        return e

    def sum(self) -> Node:
        e = self.product()
        while self.peek() in ("+", "-"):
            op, self.i = self.peek(), self.i + 1
            e = Node(op, (e, self.product()))
        return e

    def product(self) -> Node:
        e = self.atom()
        while self.peek() in ("*", "/"):
            op, self.i = self.peek(), self.i + 1
            e = Node(op, (e, self.atom()))
        return e

    def atom(self) -> Node:
        if self.take("("):
            if self.peek() == "select":
                raise DialectError("subqueries aren't in the dialect")
            e = self.expression()
            self.need(")")
            return e
        kind, text = self.toks[self.i] if self.i < len(self.toks) else ("end", "")
        if kind == "string":
            self.i += 1
            return Node("text", value=text[1:-1].replace("''", "'"))
        if kind == "number" or text == "-" and self.i + 1 < len(self.toks) and self.toks[self.i + 1][0] == "number":
            sign = -1 if text == "-" else 1
            self.i += 1 + (text == "-")
            text = self.toks[self.i - 1][1]
            return Node("number", value=sign * (int(text) if text.isdigit() else float(text)))
        if kind == "name" and self.peek(1) == "(":
            return self.call(self.name().lower())
        return self.column()

    def call(self, f: str) -> Node:
        self.need("(")
        if self.take("distinct"):
            raise DialectError("DISTINCT within an aggregate isn't in the dialect")
        if f == "count" and self.take("*"):
            args: list[Node] = []
        else:
            args = [self.expression()]
            while self.take(","):
                args.append(self.expression())
        self.need(")")
        if self.peek() in ("over", "filter"):
            raise DialectError(f"{self.peek().upper()} isn't in the dialect")
        if f in ("tumble", "hop"):
            if len(args) != (2 if f == "tumble" else 3) or any(a.kind != "text" for a in args[1:]) or args[0] != Node("column", value="event_time"):
                raise DialectError(f"{f.upper()} takes event_time and {'a size' if f == 'tumble' else 'a size and a slide'}")
            return Node(f, (), tuple(duration(str(a.value)) for a in args[1:]))
        if f not in AGGREGATES:
            raise DialectError(f"unknown function {f.upper()}")
        if len(args) > 1 or not args and f != "count":
            raise DialectError(f"{f.upper()} takes one argument")
        if any(n.kind in AGGREGATES or n.kind in ("tumble", "hop") for a in args for n in a.walk()):
            raise DialectError("aggregates don't nest")
        return Node(f, tuple(args))


def duration(text: str) -> int:
    """Nanoseconds of '10s', '250ms', '5m' or '7ns'."""
    m = re.fullmatch(r"\s*(\d+)\s*(ns|ms|s|m)\s*", text)
    if not m or not int(m[1]):
        raise DialectError(f"no duration: {text!r}")
    return int(m[1]) * UNIT_NS[m[2]]


def parse(sql: str) -> Statement:
    return _Parser(sql).statement()


def _is_window(e: Node) -> bool:
    return e.kind in ("tumble", "hop")


class Session:
    """Runs statements over tables up to a cursor time (inclusive; None: all of them)."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], cursor_ns: int | None = None, lookback_ns: int = LOOKBACK_NS, lookahead_ns: int = LOOKAHEAD_NS):
        self.spark, self.cursor_ns, self.bounds = spark, cursor_ns, (lookback_ns, lookahead_ns)
        self.tables = {n: spark.createDataFrame([], s) for n, s in CATALOG.items()} | tables

    def _scan(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise DialectError(f"unknown table {name}")
        df = self.tables[name]
        if "service" in df.columns:
            df = df.where("service is not null")
        return df if self.cursor_ns is None or "event_time" not in df.columns else df.where(F.col("event_time") <= self.cursor_ns)

    def query(self, sql: str) -> DataFrame:
        s = parse(sql)
        df = self._scan(s.table)
        if s.join:
            if s.table in ("deployments", "incidents") or "service" not in df.columns:
                raise DialectError(f"{s.table} can't be joined with deployments")
            keys = self._counted(s, df)
            if keys is None:
                df = change_join(df, self._scan("deployments"), *self.bounds, how=s.join)
            else:
                df = counted_join(self._needed(s, df), self._scan("deployments"), *self.bounds, keys, COUNT)
        known, self._types = set(df.columns), dict(df.dtypes)
        for e in [e for _, e in s.items] + s.group + ([s.where] if s.where else []):
            for n in e.walk():
                if n.kind == "column" and n.value not in known:
                    raise DialectError(f"unknown column {n.value}")
        if s.where is not None:
            if any(n.kind in AGGREGATES or _is_window(n) for n in s.where.walk()):
                raise DialectError("aggregates and windows can't stand in WHERE")
            df = df.where(self._predicate(s.where))
        found = [e for e in [e for _, e in s.items] + s.group if _is_window(e)]
        if len({(e.kind, e.value) for e in found}) > 1:
            raise DialectError("one window a statement")
        if any(_is_window(n) for _, e in s.items for n in e.walk() if n is not e):
            raise DialectError("a window stands alone")
        if found:
            e = found[0]
            t = F.col("event_time")
            df = df.withColumn("window_start", tumble_start(t, e.value[0]) if e.kind == "tumble" else F.explode(hop_starts(t, *e.value)))
        aggregates = list(dict.fromkeys(n for _, e in s.items for n in e.walk() if n.kind in AGGREGATES))
        if s.grouped or aggregates:
            df = self._grouped(df, s, found, aggregates)
        else:
            df = df.select(*(self._value(e).alias(a) for a, e in s.items))
        return self._ordered(df, s)

    @staticmethod
    def _counted(s: Statement, df: DataFrame) -> list[str] | None:
        """Columns of the changes that an aggregate over an inner join names, if it can be had of counts of pairs, without the pairs; else None."""
        outer = [e for _, e in s.items] + s.group
        names = {n.value for e in outer + ([s.where] if s.where else []) for n in e.walk() if n.kind == "column"}
        aggregates = [n for e in outer for n in e.walk() if n.kind in AGGREGATES]
        keys = [c for c in ("change_id", "change_type", "version_after") if c in names]
        inner = {n.value for a in aggregates for n in a.walk() if n.kind == "column"}
        where = s.where is None or not any(n.kind in AGGREGATES or _is_window(n) for n in s.where.walk())
        apart = not set(df.columns) & {*JOINED, COUNT, "change_time"} and {"service", "event_time"} <= set(df.columns)
        fine = s.join == "inner" and aggregates and apart and where and names <= {*df.columns, *keys} and inner <= set(df.columns) and not any(a.kind in QUANTILES for a in aggregates)
        return keys if fine else None

    def _needed(self, s: Statement, df: DataFrame) -> DataFrame:
        """The telemetry of a counted join: columns that the statement names, and rows that WHERE leaves if it names no other."""
        self._types = dict(df.dtypes)
        named = {n.value for e in [e for _, e in s.items] + s.group + ([s.where] if s.where else []) for n in e.walk() if n.kind == "column"}
        if s.where is not None and {n.value for n in s.where.walk() if n.kind == "column"} <= set(df.columns):
            df = df.where(self._predicate(s.where))
        return df.select(*(c for c in df.columns if c in named or c in ("service", "event_time")))

    def _grouped(self, df: DataFrame, s: Statement, windows: list[Node], aggregates: list[Node]) -> DataFrame:
        # A window in the SELECT list groups too.
        keys = list(dict.fromkeys(["window_start" if _is_window(e) else e.value if e.kind == "column" else self._refuse("GROUP BY takes columns and windows") for e in s.group] + ["window_start"] * bool(windows)))
        named = {n: f"__a{i}" for i, n in enumerate(aggregates)}
        times = F.col(COUNT) if COUNT in df.columns else None
        plain = [self._aggregate(n, times).alias(named[n]) for n in aggregates if n.kind not in QUANTILES]
        out = df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("__n")]))
        by_column: dict[Node, list[Node]] = {}
        for n in aggregates:
            if n.kind in QUANTILES:
                by_column.setdefault(n.args[0], []).append(n)
        for i, (arg, ns) in enumerate(by_column.items()):
            q = quantiles(sketch(df, keys or [F.lit(0).alias("__all")], self._value(arg)), {named[n]: QUANTILES[n.kind] for n in ns}).drop("count")
            q = q.select(*(F.col(k).alias(f"__k{i}_{k}") for k in keys), *(named[n] for n in ns))
            cond = F.lit(True)
            for k in keys:
                cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}_{k}"))
            out = out.join(q, cond, "left")
        for _, e in s.items:
            for n in e.walk():
                if n.kind == "column" and n.value not in keys and not any(n in a.walk() for a in aggregates):
                    self._refuse(f"{n.value} is neither grouped nor aggregated")
        return out.select(*(self._value(e, named).alias(a) for a, e in s.items))

    @staticmethod
    def _refuse(why: str):
        raise DialectError(why)

    def _aggregate(self, n: Node, times: Column | None = None) -> Column:
        if n.kind == "count":
            one = self._value(n.args[0]) if n.args else F.lit(1)
            return F.count(one) if times is None else F.coalesce(F.sum(F.when(one.isNotNull(), times)), F.lit(0))
        a = n.args[0]
        if n.kind in ("min", "max") and a.kind == "column" and self._types.get(a.value) in ("bigint", "int"):
            return F.min(a.value) if n.kind == "min" else F.max(a.value)  # nanoseconds don't fit a double
        v = self._value(a).try_cast("double")
        if times is not None and n.kind in ("sum", "avg"):
            total = F.sum(v * times)
            return F.coalesce(total, F.lit(0.0)) if n.kind == "sum" else F.try_divide(total, F.sum(F.when(v.isNotNull(), times)))
        return F.coalesce(F.sum(v), F.lit(0.0)) if n.kind == "sum" else {"avg": F.avg, "min": F.min, "max": F.max}[n.kind](v)

    def _ordered(self, df: DataFrame, s: Statement) -> DataFrame:
        names = {c.lower(): c for c in df.columns}
        for c, _ in s.order:
            if c not in names:
                raise DialectError(f"ORDER BY {c}: no such column in the result")
        if s.order:
            df = df.orderBy(*(F.col(names[c]).desc() if down else F.col(names[c]).asc() for c, down in s.order))
        return df if s.limit is None else df.limit(s.limit)

    def _predicate(self, e: Node) -> Column:
        if e.kind in ("and", "or"):
            a, b = map(self._predicate, e.args)
            return a & b if e.kind == "and" else a | b
        if e.kind == "not":
            return ~self._predicate(e.args[0])
        if e.kind == "like":
            return self._value(e.args[0]).cast("string").like(e.args[1].value)
        if e.kind in ("=", "<>", "<", "<=", ">", ">="):
            a, b = map(self._value, e.args)
            if {"text", "number"} <= set(map(self._kind, e.args)):
                raise DialectError("text and number can't be compared")
            return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[e.kind](b)
        raise DialectError("WHERE needs a condition")

    def _kind(self, e: Node) -> str:
        if e.kind == "column":
            return "text" if self._types.get(e.value) == "string" else "number"
        return "text" if e.kind == "text" else "number"

    def _value(self, e: Node, named: dict[Node, str] | None = None) -> Column:
        if named and e in named:
            return F.col(named[e])
        if e.kind == "column":
            return F.col(e.value)
        if _is_window(e):
            return F.col("window_start")
        if e.kind in ("text", "number"):
            return F.lit(e.value)
        if e.kind in ("+", "-", "*", "/"):
            a, b = (self._value(x, named).try_cast("double") for x in e.args)
            return ratio(a, b) if e.kind == "/" else {"+": a.__add__, "-": a.__sub__, "*": a.__mul__}[e.kind](b)
        return F.when(self._predicate(e), 1).otherwise(0)

    def explain(self, sql: str, analyze: bool = False) -> str:
        """JSON of the statement's steps and of Spark's plan; with ``analyze`` also rows and seconds."""
        s = parse(sql)
        df = self.query(sql)
        steps = [f"scan {s.table}"] + [f"{s.join} temporal join deployments"] * bool(s.join) + ["filter"] * (s.where is not None)
        steps += [f"window {e.kind}" for e in [e for _, e in s.items] + s.group if _is_window(e)][:1]
        steps += ["aggregate"] * (s.grouped or any(n.kind in AGGREGATES for _, e in s.items for n in e.walk())) + ["project"]
        steps += [f"top {s.limit}" if s.order else f"limit {s.limit}"] * (s.limit is not None)
        out = {"steps": steps, "columns": df.columns, "plan": df._jdf.queryExecution().simpleString()}
        if analyze:
            t = time.monotonic()
            out |= {"rows": df.count(), "seconds": round(time.monotonic() - t, 3)}
        return json.dumps(out, indent=1)
