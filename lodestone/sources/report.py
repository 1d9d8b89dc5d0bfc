"""Reports: controls, arguments and the retrieval of datawindow sources."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SCHEMA = "file string, tag string, name string, value string, op string, other string, logic string, ordinal int"
_PART = re.compile(r"""\s+|(?P<string>"(?:~.|[^"~])*"|'[^']*')|(?P<mark>[()=,])|(?P<word>[^\s()=,"']+)""", re.S)
_BLOCK = re.compile(r"\s*(\w+)\s*\(", re.S)
_PAIR = re.compile(r"""(\w+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s()]+))""", re.S)


@dataclass
class Retrieve:
    raw: str | None = None
    tables: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    where: list[tuple[str, str, str, str | None]] = field(default_factory=list)
    joins: list[tuple[str, str, str]] = field(default_factory=list)
    arguments: list[tuple[str, str]] = field(default_factory=list)


def unescape(text: str) -> str:
    return re.sub(r"~(.)", r"\1", text, flags=re.S)


def elements(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(name, properties) of each element at the top; a nested element's text is its property's value."""
    depth, name, at = 0, "", 0
    last = ""
    for m in _PART.finditer(text):
        if m.lastgroup == "mark" and m.group() == "(":
            depth += 1
            if depth == 1:
                name, at = last.lower(), m.end()
        elif m.lastgroup == "mark" and m.group() == ")":
            depth -= 1
            if depth == 0:
                yield name, properties(text[at : m.start()])
        elif m.lastgroup == "word" and depth == 0:
            last = m.group().rsplit(";", 1)[-1]


def _closing(parts: list[re.Match], i: int) -> int:
    """The place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(parts)):
        depth += (parts[j].group() == "(") - (parts[j].group() == ")")
        if depth == 0:
            return j
    return len(parts) - 1


def properties(body: str) -> dict[str, str]:
    """name -> value of an element; a repeated name keeps its values, separated by a unit separator."""
    out: dict[str, str] = {}
    parts = [m for m in _PART.finditer(body) if m.lastgroup]
    i = 0
    while i + 2 < len(parts):
        key, equals, v = parts[i], parts[i + 1], parts[i + 2]
        if key.lastgroup != "word" or equals.group() != "=":
            i += 1
            continue
        if v.group() == "(":
            end = _closing(parts, i + 2)
            value, i = body[v.end() : parts[end].start()], end + 1
        else:
            value, i = unescape(v.group()[1:-1]) if v.lastgroup == "string" else v.group(), i + 3
            if i < len(parts) and parts[i].group() == "(":
                end = _closing(parts, i)
                value, i = value + body[parts[i].start() : parts[end].end()], end + 1
        name = key.group().lower()
        out[name] = f"{out[name]}\x1f{value}" if name in out else value
    return out


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """(NAME, inside) of each block of a PBSELECT, strings and nested brackets being passed over."""
    at = 0
    while m := _BLOCK.search(text, at):
        depth, quoted, i = 1, False, m.end()
        while i < len(text) and depth:
            c = text[i]
            quoted ^= c == '"'
            depth += (c == "(" and not quoted) - (c == ")" and not quoted)
            i += 1
        yield m[1].upper(), text[m.end() : i - 1]
        at = i


def retrieve(text: str) -> Retrieve:
    """The retrieval of a report: a PBSELECT in parts, other SQL as it is."""
    m = re.match(r"\s*PBSELECT\s*\(", text, re.I)
    if not m:
        return Retrieve(raw=text)
    out = Retrieve()
    for name, inside in blocks(unescape(text[m.end() :])):
        p = {k.upper(): "".join(v) for k, *v in _PAIR.findall(inside)}
        if name == "TABLE":
            out.tables.append(p.get("NAME", ""))
        elif name == "COLUMN":
            out.columns.append(p.get("NAME", ""))
        elif name == "WHERE":
            out.where.append((p.get("EXP1", ""), p.get("OP", ""), p.get("EXP2", ""), p.get("LOGIC") or None))
        elif name == "JOIN":
            out.joins.append((p.get("LEFT", ""), p.get("OP", ""), p.get("RIGHT", "")))
        elif name == "ARG":
            out.arguments.append((p.get("NAME", ""), p.get("TYPE", "")))
    return out


def reconstruct(r: Retrieve) -> str:
    """A runnable SELECT: qualifiers dropped, arguments as ``?``, conditions chained by their connectors; joins and order are not part of it, as in the reference."""
    if r.raw is not None:
        return r.raw
    short = lambda x: x.rsplit(".", 1)[-1]
    sql = f"SELECT {', '.join(map(short, r.columns))} FROM {', '.join(r.tables)}"
    chain = ""
    for i, (left, op, right, logic) in enumerate(r.where):
        chain += f"{short(left)} {op} {'?' if right.startswith(':') else right}"
        chain += "" if i == len(r.where) - 1 else f" {(logic or 'AND').upper()} "
    return f"{sql} WHERE {chain}" if chain else sql


def facts(text: str) -> list[tuple]:
    """(tag, name, value, op, other, logic, ordinal): control, column, retrieve, table, where, join, argument rows of one report."""
    out: list[tuple] = []
    for i, (name, p) in enumerate(elements(text)):
        if name == "table":
            for k, c in enumerate(p.get("column", "").split("\x1f")):
                q = properties(c)
                if q:
                    out.append(("column", q.get("name"), q.get("dbname"), q.get("type"), q.get("update"), None, k))
            if "retrieve" in p:
                r = retrieve(p["retrieve"])
                out.append(("retrieve", None, reconstruct(r), "raw" if r.raw is not None else "pbselect", None, None, None))
                out += [("table", t, None, None, None, None, k) for k, t in enumerate(r.tables)]
                out += [("selected", c, None, None, None, None, k) for k, c in enumerate(r.columns)]
                out += [("where", a, None, op, b, logic, k) for k, (a, op, b, logic) in enumerate(r.where)]
                out += [("join", a, None, op, b, None, k) for k, (a, op, b) in enumerate(r.joins)]
                out += [("argument", a, t, None, None, None, k) for k, (a, t) in enumerate(r.arguments)]
        elif "name" in p or "band" in p:
            out.append(("control", p.get("name"), name, p.get("band"), p.get("x"), p.get("y"), i))
    return out


def report_facts(files: DataFrame) -> DataFrame:
    """The rows of ``facts`` of each report of files (file, lines). NULL texts give none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [(f, *r) for f, text in zip(pdf.file, pdf.lines, strict=True) for r in facts(text)]
            yield pd.DataFrame(rows, columns=columns).astype({"ordinal": "Int32"})

    return files.where("lines is not null").select("file", "lines").mapInPandas(run, SCHEMA)


def pipeline_facts(text: str) -> list[tuple[str, str | None, str | None]]:
    """(tag, name, value) of a pipeline: source and destination tables, their columns, the statement."""
    out: list[tuple[str, str | None, str | None]] = []
    for name, p in elements(text):
        if name in ("source", "destination"):
            out.append((name, p.get("name"), None))
        elif name == "retrieve":
            out.append(("statement", None, p.get("statement")))
        elif name == "pipeline":
            out += [("option", k, v) for k, v in p.items()]
    return out


def project_facts(text: str) -> list[tuple[str, list[str]]]:
    """(TAG, fields) of a project's lines."""
    rows = (line.partition(":") for line in text.replace("\r\n", "\n").split("\n"))
    return [(tag, rest.split(",")) for tag, colon, rest in rows if colon and tag.isalpha()]
