"""A subset of openCypher, compiled to DataFrame plans.

    query   := match+ where? return?
    match   := 'OPTIONAL'? 'MATCH' pattern (',' pattern)*
    pattern := node (rel node)*
    node    := '(' name? (':' label)? ')'
    rel     := '-' body? '->' | '<-' body? '-'      body := '[' name? (':' type)? range? ']'
    range   := '*' (int '..' int)?                  a bare * is one step
    where   := 'WHERE' cond ('AND' cond)*
    cond    := name '.' prop op string              op := '=' | LIKE | CONTAINS | STARTS WITH | ENDS WITH
    return  := 'RETURN' 'DISTINCT'? item (',' item)* ('ORDER BY' key (',' key)*)? ('SKIP' int)? ('LIMIT' int)?
    item    := (agg '(' ('*' | name | name '.' prop) ')' | name '.' prop | name) ('AS' name)?
    agg     := COUNT | COLLECT | SUM | MIN | MAX

WITH and UNWIND clauses are passed over. Without RETURN, name and label of the
first node are returned. Rows are distinct; items beside aggregates group.
Without LIMIT, 50 rows are returned; what ORDER BY leaves open is ordered by the
returned columns, so the same rows come each time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import reach

DEFAULT_LIMIT = 50
AGGREGATES = ("COUNT", "COLLECT", "SUM", "MIN", "MAX")
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(<-|->|\.\.|[()\[\]:,.*=<>-]))")


class CypherError(ValueError):
    """The query isn't of the subset."""


@dataclass(frozen=True)
class NodePattern:
    name: str
    label: str | None = None


@dataclass(frozen=True)
class Hop:
    type: str | None = None
    low: int = 1
    high: int = 1
    back: bool = False
    ranged: bool = False


@dataclass
class Pattern:
    nodes: list[NodePattern]
    hops: list[Hop]
    optional: bool = False


@dataclass(frozen=True)
class Condition:
    name: str
    prop: str
    op: str
    value: str


@dataclass(frozen=True)
class Item:
    name: str
    prop: str | None = None
    aggregate: str | None = None
    alias: str | None = None
    distinct: bool = False


@dataclass
class Query:
    patterns: list[Pattern] = field(default_factory=list)
    where: list[Condition] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int | None = None


class Parser:
    def __init__(self, text: str, lenient: bool = False):
        self.lenient = lenient
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if not text[at:].strip():
                    break
                raise CypherError(f"can't read {text[at : at + 20]!r}")
            kind = ("string", "int", "name", "sign")[m.lastindex - 1]
            value = m.group(m.lastindex)
            self.tokens.append((kind, re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "string" else value))
            at = m.end()
        self.at = 0
        self.unnamed = 0

    def peek(self, *words: str) -> bool:
        for i, w in enumerate(words):
            if self.at + i >= len(self.tokens):
                return False
            kind, value = self.tokens[self.at + i]
            if kind == "string" or value.upper() != w:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"{word} expected at {self.tokens[self.at : self.at + 3]}")

    def any(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise CypherError(f"{kind} expected at {self.tokens[self.at : self.at + 3]}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def is_name(self) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "name"

    def parse(self) -> Query:
        q = Query()
        while self.at < len(self.tokens):
            if self.peek("MATCH") or self.peek("OPTIONAL", "MATCH"):
                optional = self.take("OPTIONAL")
                self.need("MATCH")
                while True:
                    p = self.pattern()
                    p.optional = optional
                    q.patterns.append(p)
                    if not self.take(","):
                        break
            elif self.take("WHERE"):
                q.where.append(self.condition())
                while self.take("AND"):
                    q.where.append(self.condition())
            elif self.take("RETURN"):
                self.returns(q)
            elif self.peek("WITH") or self.peek("UNWIND"):
                word = self.any("name").upper()
                if not self.lenient:
                    raise CypherError(f"{word} is not supported; lenient=True passes over it")
                while self.at < len(self.tokens) and not any(self.peek(w) for w in ("MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "UNWIND")):
                    self.at += 1
            else:
                raise CypherError(f"unexpected {self.tokens[self.at]}")
        if not q.patterns:
            raise CypherError("no MATCH")
        if not q.items:
            first = q.patterns[0].nodes[0].name
            q.items = [Item(first, "name"), Item(first, "label")]
        return q

    def node(self) -> NodePattern:
        self.need("(")
        if self.is_name():
            name = self.any("name")
        else:
            self.unnamed += 1
            name = f"_{self.unnamed}"
        label = self.any("name") if self.take(":") else None
        self.need(")")
        return NodePattern(name, label)

    def hop(self) -> Hop:
        back = self.take("<-")
        if not back:
            self.need("-") if not self.peek("->") else None
        type_, low, high, ranged = None, 1, 1, False
        if self.take("["):
            if self.is_name():
                self.any("name")
            if self.take(":"):
                type_ = self.any("name")
            if self.take("*"):
                ranged = True
                if self.at < len(self.tokens) and self.tokens[self.at][0] == "int":
                    low = high = int(self.any("int"))
                    if self.take(".."):
                        high = int(self.any("int"))
            self.need("]")
        if back:
            self.need("-")
        else:
            self.need("->")
        if not 0 <= low <= high:
            raise CypherError(f"range *{low}..{high}")
        return Hop(type_, low, high, back, ranged)

    def pattern(self) -> Pattern:
        nodes, hops = [self.node()], []
        while self.peek("-") or self.peek("<-") or self.peek("->"):
            hops.append(self.hop())
            nodes.append(self.node())
        return Pattern(nodes, hops)

    def condition(self) -> Condition:
        name = self.any("name")
        self.need(".")
        prop = self.any("name")
        for op in (("=",), ("LIKE",), ("CONTAINS",), ("STARTS", "WITH"), ("ENDS", "WITH")):
            if self.take(*op):
                return Condition(name, prop, " ".join(op), self.any("string"))
        raise CypherError(f"no comparison at {self.tokens[self.at : self.at + 2]}")

    def item(self) -> Item:
        name, prop, aggregate, distinct = self.any("name"), None, None, False
        if name.upper() in AGGREGATES and self.take("("):
            aggregate = name.upper()
            if self.take("*"):
                name = "*"
            else:
                distinct = self.take("DISTINCT")
                name = self.any("name")
            if name != "*" and self.take("."):
                prop = self.any("name")
            self.need(")")
        elif self.take("."):
            prop = self.any("name")
        return Item(name, prop, aggregate, self.any("name") if self.take("AS") else None, distinct)

    def returns(self, q: Query) -> None:
        self.take("DISTINCT")
        q.items.append(self.item())
        while self.take(","):
            q.items.append(self.item())
        if self.take("ORDER", "BY"):
            while True:
                key = self.any("name")
                if self.take("."):
                    key += "." + self.any("name")
                down = self.take("DESC")
                if not down:
                    self.take("ASC")
                q.order.append((key, down))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            q.skip = int(self.any("int"))
        if self.take("LIMIT"):
            q.limit = int(self.any("int"))


def parse(text: str, lenient: bool = False) -> Query:
    """lenient passes over WITH and UNWIND with all they say, as the language's first form here did."""
    return Parser(text, lenient).parse()


def column(name: str, prop: str) -> str:
    return f"{name}__{prop}"


def _like(value: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", value)


def test(c: Column, op: str, value: str) -> Column:
    if op == "=":
        return c.cast("string") == value
    if op == "LIKE":
        return c.cast("string").ilike(value.replace("\\", "\\\\"))
    v = _like(value)
    return c.cast("string").ilike({"CONTAINS": f"%{v}%", "STARTS WITH": f"{v}%", "ENDS WITH": f"%{v}"}[op])


class Compiler:
    """Turns a parsed query into one lazy plan over nodes and edges."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, first_edge: bool = False, default_limit: int | None = DEFAULT_LIMIT):
        self.nodes, self.edges, self.first_edge, self.default_limit = nodes, edges, first_edge, default_limit

    def side(self, p: NodePattern, where: list[Condition], properties: dict[str, set[str]]) -> DataFrame:
        """The nodes that a pattern can stand for, with only the properties that are used."""
        df = self.nodes
        if p.label:
            df = df.where(F.col("label") == p.label)
        for c in where:
            if c.name == p.name:
                df = df.where(test(F.col(self.known(c.prop)), c.op, c.value))
        return df.select(*[F.col(self.known(x)).alias(column(p.name, x)) for x in sorted(properties.get(p.name, set()) | {"id"})])

    def known(self, prop: str) -> str:
        if prop not in self.nodes.columns:
            raise CypherError(f"unknown property {prop}")
        return prop

    def step(self, hop: Hop, starts: DataFrame | None = None) -> DataFrame:
        """(_a, _b): the pairs of ends of a hop; walks of several edges begin at `starts` (id) only."""
        used = self.edges if hop.type is None else self.edges.where(F.col("type") == hop.type)
        used = used.where("dst IS NOT NULL")
        if hop.ranged and (hop.low, hop.high) != (1, 1):
            if hop.back:
                used = used.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            pairs = reach(used, hop.low, hop.high, sources=starts)
            return pairs.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
        if self.first_edge:
            order = [c for c in ("id", "dst") if c in used.columns]
            used = used.withColumn("_n", F.row_number().over(Window.partitionBy("src", "type").orderBy(*order))).where("_n = 1")
        a, b = ("dst", "src") if hop.back else ("src", "dst")
        return used.select(F.col(a).alias("_a"), F.col(b).alias("_b"))

    def chain(self, p: Pattern, where: list[Condition], properties: dict[str, set[str]]) -> DataFrame:
        df = self.side(p.nodes[0], where, properties)
        seen = {p.nodes[0].name}
        for hop, left, right in zip(p.hops, p.nodes, p.nodes[1:], strict=False):
            df = df.join(self.step(hop, df.select(F.col(column(left.name, "id")).alias("id"))), df[column(left.name, "id")] == F.col("_a")).drop("_a")
            if right.name in seen:
                df = df.where(F.col("_b") == F.col(column(right.name, "id"))).drop("_b")
            else:
                other = self.side(right, where, properties)
                df = df.join(other, F.col("_b") == F.col(column(right.name, "id"))).drop("_b")
                seen.add(right.name)
        return df

    def compile(self, q: Query) -> DataFrame:
        names = {n.name for p in q.patterns for n in p.nodes}
        properties: dict[str, set[str]] = {}
        for x in [*q.items, *q.where]:
            if x.name != "*" and x.name not in names:
                raise CypherError(f"unknown name {x.name}")
            if x.name != "*":
                properties.setdefault(x.name, set()).add(x.prop or "name")
        for key, _ in q.order:
            if "." in key:
                name, prop = key.split(".")
                properties.setdefault(name, set()).add(prop)
        df: DataFrame | None = None
        bound: set[str] = set()
        for p in q.patterns:
            own = {n.name for n in p.nodes}
            if df is None:
                df = self.side(p.nodes[0], q.where, properties) if p.optional and p.hops else self.chain(p, q.where, properties)
                bound = {p.nodes[0].name} if p.optional and p.hops else own
                if bound == own:
                    continue
            shared = sorted(own & bound)
            if not shared:
                raise CypherError("patterns without a common name would pair all their rows")
            more = self.chain(p, q.where, properties)
            new = [c for c in more.columns if c.split("__")[0] not in bound]
            keys = [column(n, "id") for n in shared]
            df = df.join(more.select(*keys, *new).distinct(), keys, "left" if p.optional else "inner")
            bound |= own
        return self.project(df, q)

    def project(self, df: DataFrame, q: Query) -> DataFrame:
        plain = [i for i in q.items if not i.aggregate]
        props = [i.prop or "name" for i in plain]
        names: dict[int, str] = {}
        for i in q.items:
            if i.alias:
                names[id(i)] = i.alias
            elif i.aggregate:
                names[id(i)] = f"{i.aggregate.lower()}_total" if i.name == "*" else f"{i.aggregate.lower()}_{i.name}" + (f"_{i.prop}" if i.prop else "")
            else:
                prop = i.prop or "name"
                names[id(i)] = prop if props.count(prop) == 1 else f"{i.name}_{prop}"
        of = {(i.name, i.prop or "name"): names[id(i)] for i in plain}
        value = lambda i: F.col(column(i.name, i.prop or "name"))
        if len(plain) < len(q.items):
            aggs = []
            for i in q.items:
                if i.aggregate == "COUNT":
                    counted = F.col(column(i.name, i.prop or "id"))
                    a = F.count("*") if i.name == "*" else F.count_distinct(counted) if i.distinct else F.count(counted)
                elif i.aggregate == "COLLECT":
                    # one row holds all values of its group, as the language asks for
                    a = F.array_join(F.sort_array((F.collect_set if i.distinct else F.collect_list)(value(i).cast("string"))), ",")
                elif i.aggregate:
                    a = {"SUM": F.sum_distinct if i.distinct else F.sum, "MIN": F.min, "MAX": F.max}[i.aggregate](value(i))
                else:
                    continue
                aggs.append(a.alias(names[id(i)]))
            out = df.groupBy(*[value(i).alias(names[id(i)]) for i in plain]).agg(*aggs)
        else:
            out = df.select(*[value(i).alias(names[id(i)]) for i in plain]).distinct()
        out = out.select(*[names[id(i)] for i in q.items])
        limit = self.default_limit if q.limit is None else q.limit
        keys = []
        for key, down in q.order:
            name = of.get(tuple(key.split("."))) if "." in key else key
            if name not in out.columns:
                raise CypherError(f"ORDER BY {key}: not returned")
            keys.append(F.desc(name) if down else F.asc(name))
        if limit is None and not q.skip and not keys:
            return out
        ordered = out.orderBy(*keys, *[F.asc(c) for c in out.columns])
        ordered = ordered.offset(q.skip) if q.skip else ordered
        return ordered if limit is None else ordered.limit(limit)


def query(nodes: DataFrame, edges: DataFrame, text: str, first_edge: bool = False, default_limit: int | None = DEFAULT_LIMIT, lenient: bool = False) -> DataFrame:
    """The rows of a query.

    first_edge follows one edge per source and type only. With default_limit
    None a query without LIMIT returns all rows, in no order but its own.
    """
    return Compiler(nodes, edges, first_edge, default_limit).compile(parse(text, lenient))
