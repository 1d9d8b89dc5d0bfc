"""Lineage of embedded SQL: rewrites, tokens, tables, columns by scope, row filters.

A statement is read by a small tokenizer and a recursive reader of query scopes; no
SQL library is needed. What isn't certain stays NULL: an unqualified column of several
tables belongs to one only if the catalog says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SCHEMA = "tag string, namespace string, table_name string, column_name string, is_write boolean, op string, value string"
# Statements without structure, and the words that end a FROM list or are no columns.
_SKIP = re.compile(r"\s*(?:connect|disconnect|open|close|fetch|commit|rollback|execute\s+(?:immediate|procedure)|declare\s+\w+\s+(?:dynamic\s+cursor\s+for\s+\w+\s*;?\s*$|procedure\s+for\s+\w+))\b", re.I)
_WORDS = frozenset(
    "select from where and or not in is null like between exists group by having order asc desc union all distinct as on join inner left right full outer cross natural using insert into values update set delete case when then else end count sum avg min max cast limit offset fetch first rows only with minus intersect except escape any some connect start prior nocycle level sysdate current_date current_timestamp true false top for of nowait interval date timestamp over partition".split()
)
_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<text>'(?:[^']|'')*')|(?P<name>"[^"]+"|`[^`]+`|\[[A-Za-z_][^\]]*\]|[A-Za-z_#][\w$#]*)|(?P<number>\d+(?:\.\d+)?)|(?P<host>:\s*\w+(?:\.\w+)*|\?)|(?P<mark><=|>=|<>|!=|\|\||[-+*/%(),.;=<>])|(?P<bad>.)""", re.S)


def standard(sql: str) -> str | None:
    """The statement in plain SQL, or None for a form without structure."""
    if _SKIP.match(sql):
        return None
    sql = re.sub(r"//[^\n]*", "", sql)
    sql = re.sub(r"\busing\s+\w+\b(?!\s*\()", "", sql, flags=re.I)
    sql = re.sub(r"\binto\s+:\s*\w+(?:\.\w+)?(?:\s*,\s*:\s*\w+(?:\.\w+)?)*", "", sql, flags=re.I)
    if m := re.match(r"\s*declare\s+\w+\s+cursor\s+for\s*(.*)$", sql, re.I | re.S):
        sql = m[1]
    if not re.search(r"\bconnect\s+by\b", sql, re.I):
        sql = re.sub(r"\bstart\s+with\b", "WHERE", sql, flags=re.I)
    return sql


@dataclass
class Token:
    kind: str
    text: str


@dataclass
class Lineage:
    tables: dict[tuple[str | None, str], None] = field(default_factory=dict)
    columns: list[tuple[str | None, str | None, str, bool]] = field(default_factory=list)
    filters: list[tuple[str | None, str, str, tuple[str, ...]]] = field(default_factory=list)


def tokens(sql: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(sql):
        if m.lastgroup == "bad":
            raise ValueError(f"unexpected {m.group()!r}")
        if m.lastgroup:
            text = m.group()
            out.append(Token(m.lastgroup, text.strip('"`[]').lower() if m.lastgroup == "name" else text))
    return out


class _Reader:
    def __init__(self, sql: str, catalog: dict[str, list[str]] | None) -> None:
        self.t, self.catalog, self.out = tokens(sql), catalog or {}, Lineage()
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.text == "(":
                stack.append(i)
            elif t.text == ")":
                if not stack:
                    raise ValueError("unbalanced brackets")
                self.match[stack.pop()] = i
        if stack:
            raise ValueError("unbalanced brackets")

    def word(self, i: int, *words: str) -> bool:
        return i < len(self.t) and self.t[i].kind == "name" and self.t[i].text in words

    def read(self) -> Lineage:
        if not self.t:
            raise ValueError("empty statement")
        if self.word(0, "insert"):
            self.insert()
        elif self.word(0, "update"):
            self.update()
        elif self.word(0, "delete"):
            i = 1 + self.word(1, "from")
            table, i = self.table(i)
            self.scope({table[1]: table}, i, len(self.t), where=True)
        elif self.word(0, "select", "with") or self.t[0].text == "(":
            self.query(0, len(self.t), {})
        else:
            raise ValueError(f"unknown statement {self.t[0].text}")
        return self.out

    def table(self, i: int) -> tuple[tuple[str | None, str], int]:
        if i >= len(self.t) or self.t[i].kind != "name":
            raise ValueError("table expected")
        parts, i = [self.t[i].text], i + 1
        while i + 1 < len(self.t) and self.t[i].text == "." and self.t[i + 1].kind == "name":
            parts.append(self.t[i + 1].text)
            i += 2
        table = (parts[-2] if len(parts) > 1 else None, parts[-1])
        self.out.tables[table] = None
        return table, i

    def insert(self) -> None:
        table, i = self.table(1 + self.word(1, "into"))
        if i < len(self.t) and self.t[i].text == "(" and not self.word(i + 1, "select"):
            end = self.match[i]
            self.out.columns += [(*table, t.text, True) for t in self.t[i + 1 : end] if t.kind == "name"]
            i = end + 1
        if self.word(i, "select", "with") or (i < len(self.t) and self.t[i].text == "("):
            self.query(i, len(self.t), {})

    def update(self) -> None:
        table, i = self.table(1)
        while i < len(self.t) and not self.word(i, "set"):
            i += 1
        sources, stop = {table[1]: table}, next((j for j in self.flat(i, len(self.t)) if self.word(j, "where")), len(self.t))
        start = i + 1
        for j in [*[j for j in self.flat(i + 1, stop) if self.t[j].text == ","], stop]:
            k = start
            while k + 1 < j and self.t[k + 1].text == ".":
                k += 2
            if k < j and self.t[k].kind == "name":
                self.out.columns.append((*table, self.t[k].text, True))
            self.scope(sources, k + 1, j)
            start = j + 1
        self.scope(sources, stop, len(self.t), where=True)

    def flat(self, i: int, stop: int) -> Iterator[int]:
        """Places of [i, stop) outside brackets."""
        while i < stop:
            yield i
            i = self.match.get(i, i) + 1

    def query(self, i: int, stop: int, outer: dict) -> None:
        cuts = [j for j in self.flat(i, stop) if self.word(j, "union", "minus", "intersect", "except")]
        start = i
        for j in [*cuts, stop]:
            k = start
            while k < j and (self.word(k, "all", "union", "minus", "intersect", "except", "distinct") or self.t[k].text == ";"):
                k += 1
            if k < j:
                self.select(k, j)
            start = j + 1

    def select(self, i: int, stop: int) -> None:
        if self.t[i].text == "(":
            self.query(i + 1, self.match[i], {})
            return
        common: dict[str, None] = {}
        if self.word(i, "with"):
            k = i + 1
            while k < stop and not self.word(k, "select"):
                if self.t[k].kind == "name" and self.word(k + 1, "as") and self.t[k + 2].text == "(":
                    common[self.t[k].text] = None
                    self.query(k + 3, self.match[k + 2], {})
                    k = self.match[k + 2]
                k += 1
            i = k
        begin = next((j for j in self.flat(i, stop) if self.word(j, "from")), stop)
        end = next((j for j in self.flat(begin, stop) if self.word(j, "where", "group", "order", "having", "connect", "start", "for", "limit", "fetch")), stop)
        sources: dict[str, tuple[str | None, str]] = {}
        conditions: list[tuple[int, int]] = []
        k = begin + 1
        while k < end:
            if self.t[k].text == "(":
                self.query(k + 1, self.match[k], {})
                k = self.match[k] + 1
                k += self.word(k, "as")
                if k < end and self.t[k].kind == "name" and self.t[k].text not in _WORDS:
                    k += 1
            elif self.word(k, "on"):
                j = next((j for j in self.flat(k + 1, end) if self.t[j].text == "," or self.word(j, "join", "inner", "left", "right", "full", "cross", "natural")), end)
                conditions.append((k + 1, j))
                k = j
            elif self.word(k, "using"):
                k = self.match.get(k + 1, k) + 1
            elif self.t[k].kind == "name" and self.t[k].text not in _WORDS:
                table, k = self.table(k)
                if table[1] in common:
                    self.out.tables.pop(table, None)
                k += self.word(k, "as")
                alias = table[1]
                if k < end and self.t[k].kind == "name" and self.t[k].text not in _WORDS:
                    alias, k = self.t[k].text, k + 1
                if table[1] not in common:
                    sources[alias] = table
            else:
                k += 1
        self.scope(sources, i + 1, begin)
        for a, b in conditions:
            self.scope(sources, a, b)
        self.scope(sources, end, stop, where=self.word(end, "where"))

    def scope(self, sources: dict[str, tuple[str | None, str]], i: int, stop: int, where: bool = False) -> None:
        """Columns between i and stop as reads of the sources; brackets that hold a query are scopes of their own."""
        k = i
        while k < stop:
            t = self.t[k]
            if t.text == "(" and self.word(k + 1, "select", "with"):
                self.query(k + 1, self.match[k], sources)
                k = self.match[k] + 1
                continue
            if t.kind == "name" and t.text not in _WORDS and not (k + 1 < len(self.t) and self.t[k + 1].text == "("):
                parts, j = [t.text], k + 1
                while j + 1 < stop and self.t[j].text == "." and (self.t[j + 1].kind == "name" or self.t[j + 1].text == "*"):
                    parts.append(self.t[j + 1].text)
                    j += 2
                alias_here = self.word(k - 1, "as") if k > i else False
                if parts[-1] != "*" and not alias_here:
                    ns, table = self.owner(sources, parts)
                    self.out.columns.append((ns, table, parts[-1], False))
                    if where:
                        self.filter(parts, j, stop)
                k = j
                continue
            k += 1

    def owner(self, sources: dict[str, tuple[str | None, str]], parts: list[str]) -> tuple[str | None, str | None]:
        if len(parts) > 1:
            return sources.get(parts[-2], (None, parts[-2]))
        if len(set(sources.values())) == 1:
            return next(iter(sources.values()))
        having = {table for table in sources.values() if parts[0] in {c.lower() for c in self.catalog.get(table[1], ())}}
        return next(iter(having)) if len(having) == 1 else (None, None)

    def filter(self, parts: list[str], j: int, stop: int) -> None:
        literal = lambda k: k < stop and self.t[k].kind in ("text", "number")
        value = lambda k: self.t[k].text[1:-1].replace("''", "'") if self.t[k].kind == "text" else self.t[k].text
        qualifier = parts[-2] if len(parts) > 1 else None
        if j + 1 < stop and self.t[j].text == "=" and literal(j + 1):
            self.out.filters.append((qualifier, parts[-1], "=", (value(j + 1),)))
        elif self.word(j, "in") and j + 1 < stop and self.t[j + 1].text == "(":
            inside = [k for k in range(j + 2, self.match[j + 1]) if self.t[k].text != ","]
            if inside and all(literal(k) for k in inside):
                self.out.filters.append((qualifier, parts[-1], "in", tuple(value(k) for k in inside)))


def lineage(sql: str, catalog: dict[str, list[str]] | None = None) -> Lineage | None:
    """The lineage of a statement, None for a form without structure; ValueError if it can't be read."""
    plain = standard(sql)
    return None if plain is None else _Reader(plain.strip().rstrip(";"), catalog).read()


def rows(sql: str, catalog: dict[str, list[str]] | None = None) -> list[tuple]:
    """(tag, namespace, table, column, is_write, op, value): ``table``, ``column``, ``filter``; ``skipped`` or ``error``."""
    try:
        found = lineage(sql, catalog)
    except ValueError as e:
        return [("error", None, None, None, None, None, str(e))]
    if found is None:
        return [("skipped", None, None, None, None, None, None)]
    out: list[tuple] = [("table", ns, t, None, None, None, None) for ns, t in found.tables]
    out += [("column", ns, t, c, w, None, None) for ns, t, c, w in dict.fromkeys(found.columns)]
    out += [("filter", None, q, c, None, op, v) for q, c, op, values in found.filters for v in values]
    return out


def statement_lineage(statements: DataFrame, sql: str = "raw_sql", catalog: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows of each statement's lineage beside its other columns; a NULL statement has none."""
    keep = [f for f in statements.schema.fields if f.name != sql and f.name not in {c.split()[0] for c in SCHEMA.split(", ")}]
    names = [f.name for f in keep]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = [*names, *(c.split()[0] for c in SCHEMA.split(", "))]
        for pdf in batches:
            data = [(*own, *r) for own, text in zip(pdf[names].itertuples(index=False, name=None), pdf[sql], strict=True) if text is not None for r in rows(text, catalog)]
            yield pd.DataFrame(data, columns=columns)

    return statements.select(*names, sql).mapInPandas(run, f"{head}, {SCHEMA}")
