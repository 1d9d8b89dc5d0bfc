"""DDL dumps to catalog rows: columns, keys, checks, views, and statistics of what was skipped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lodestone.functions import sqltext

SCHEMA = "file string, tag string, namespace string, table_name string, column_name string, ordinal int, name string, to_namespace string, to_table string, to_column string, value string"
#: Characters of a skipped statement that its preview keeps.
PREVIEW = 200
_NAME = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[\w$#]+)'
_QUALIFIED = rf"{_NAME}(?:\s*\.\s*{_NAME})*"
_TABLE = re.compile(rf"create\s+(?:global\s+temporary\s+|temporary\s+)?table\s+(?:if\s+not\s+exists\s+)?({_QUALIFIED})\s*\(", re.I)
_VIEW = re.compile(rf"create\s+(?:or\s+replace\s+)?(?:force\s+)?view\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?\s*as\s+(.*)$", re.I | re.S)
_ALTER = re.compile(rf"alter\s+table\s+(?:only\s+)?({_QUALIFIED})\s+add\s+(.*)$", re.I | re.S)
_PRIMARY = re.compile(rf"(?:constraint\s+({_NAME})\s+)?primary\s+key\s*(?:clustered\s*)?\(([^)]*)\)", re.I)
_FOREIGN = re.compile(rf"(?:constraint\s+({_NAME})\s+)?foreign\s+key\s*(?:{_NAME}\s*)?\(([^)]*)\)\s*references\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?", re.I)
_CHECK = re.compile(rf"(?:constraint\s+({_NAME})\s+)?check\s*\((.*)\)\s*$", re.I | re.S)
_REFERENCES = re.compile(rf"\breferences\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?", re.I)
_NO_COLUMN = re.compile(r"(?:constraint|primary|foreign|unique|key|index|check|fulltext|spatial|period|exclude|like)\b", re.I)
# Statements that a dump has without saying anything about tables.
_QUIET = re.compile(r"(?:set|use|drop|lock|unlock|insert|commit|begin|grant|comment|alter\s+session|go|prompt|delimiter|start\s+transaction)\b", re.I)


@dataclass
class Stats:
    total: int = 0
    parsed: int = 0
    skipped: int = 0
    previews: list[str] = field(default_factory=list)
    dewrapped: bool = False


def name(text: str) -> str:
    return text.strip().strip('"`[]').lower()


def qualified(text: str, default: str | None) -> tuple[str | None, str]:
    parts = [name(p) for p in re.findall(_NAME, text)]
    return (parts[-2] if len(parts) > 1 else default, parts[-1])


def dewrap(text: str) -> tuple[str, bool]:
    """The text with hard-wrapped lines joined, if nearly all full lines have one length."""
    lines = text.split("\n")
    longest = max(map(len, lines), default=0)
    full = [i for i, line in enumerate(lines[:-1]) if len(line) == longest]
    if longest < 60 or len(full) < 5 or len(full) < 0.5 * len([line for line in lines if line.strip()]):
        return text, False
    out = ""
    for line in lines:
        out += line if len(line) == longest else line + "\n"
    return out, True


def statements(text: str) -> list[str]:
    """The statements of a dump, split at semicolons and at GO or / alone on a line, outside quotes and comments."""
    out, parts = [], []
    for m in re.finditer(r"--[^\n]*|#[^\n]*(?=\n)|/\*.*?\*/|'(?:[^'\\]|''|\\.)*'|\"[^\"]*\"|`[^`]*`|;|^[ \t]*(?:go|/)[ \t]*$|[^-#/'\"`;\n]+|.", text, re.S | re.M | re.I):
        got = m.group()
        if got == ";" or got.strip().lower() in ("go", "/") and got.strip() != "" and (m.start() == 0 or text[m.start() - 1] == "\n") and re.match(r"[ \t]*(?:go|/)[ \t]*$", got, re.I):
            out.append("".join(parts).strip())
            parts.clear()
        elif got.startswith(("--", "/*")) or (got.startswith("#") and (m.start() == 0 or text[m.start() - 1] == "\n")):
            parts.append(" ")
        else:
            parts.append(got)
    out.append("".join(parts).strip())
    return [s for s in out if s]


def items(body: str) -> list[str]:
    """The parts of a bracketed list, split at commas outside brackets and quotes."""
    out, depth, part = [], 0, ""
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|.", body, re.S):
        got = m.group()
        depth += (got == "(") - (got == ")")
        if depth < 0:
            break
        if got == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += got
    return [p for p in [*out, part.strip()] if p]


def columns_of(text: str) -> list[str]:
    return [name(re.match(_NAME, c.strip()).group()) for c in text.split(",") if re.match(_NAME, c.strip())]


def parse(text: str, default_namespace: str | None = None) -> tuple[list[tuple], Stats]:
    """(catalog rows, statistics) of a dump. Rows are the fields of SCHEMA without the file."""
    text, wrapped = dewrap(text.replace("\r\n", "\n"))
    stats, rows = Stats(dewrapped=wrapped), []
    tables: dict[tuple[str | None, str], list[str]] = {}
    views: list[tuple[tuple[str | None, str], list[str], str, str]] = []
    row = lambda tag, t, c=None, o=None, n=None, to=(None, None), tc=None, v=None: rows.append((tag, t[0], t[1], c, o, n, to[0], to[1], tc, v))

    def constraint(t: tuple[str | None, str], part: str) -> bool:
        if m := _PRIMARY.search(part):
            for i, c in enumerate(columns_of(m[2])):
                row("pk", t, c, i, name(m[1] or ""))
        elif m := _FOREIGN.search(part):
            to, targets = qualified(m[3], t[0]), columns_of(m[4] or "")
            for i, c in enumerate(columns_of(m[2])):
                row("fk", t, c, i, name(m[1] or ""), to, targets[i] if i < len(targets) else None)
        elif m := _CHECK.search(part):
            row("check", t, None, None, name(m[1] or ""), v=m[2].strip())
        else:
            return False
        return True

    for statement in statements(text):
        stats.total += 1
        if m := _TABLE.match(statement):
            t, found = qualified(m[1], default_namespace), []
            for part in items(statement[m.end() :]):
                if _NO_COLUMN.match(part):
                    constraint(t, part)
                    continue
                c = re.match(_NAME, part)
                if not c:
                    continue
                column = name(c.group())
                row("column", t, column, len(found), v=part[c.end() :].split("(")[0].split()[0].lower() if part[c.end() :].split() else None)
                found.append(column)
                if re.search(r"\bprimary\s+key\b", part, re.I):
                    row("pk", t, column, 0, "")
                if r := _REFERENCES.search(part):
                    row("fk", t, column, 0, "", qualified(r[1], t[0]), (columns_of(r[2] or "") or [None])[0])
                if k := _CHECK.search(part[c.end() :]):
                    row("check", t, column, None, name(k[1] or ""), v=k[2].strip())
            tables[t] = found
        elif m := _VIEW.match(statement):
            views.append((qualified(m[1], default_namespace), columns_of(m[2] or ""), m[3], statement))
        elif (m := _ALTER.match(statement)) and constraint(qualified(m[1], default_namespace), m[2]):
            pass
        elif _QUIET.match(statement) or re.match(r"create\s+(?:unique\s+)?index\b", statement, re.I):
            stats.skipped += 1
            stats.previews.append("[unparsed] " + re.sub(r"\s+", " ", statement)[:PREVIEW])
            continue
        else:
            stats.skipped += 1
            stats.previews.append("[unparsed] " + re.sub(r"\s+", " ", statement)[:PREVIEW])
            continue
        stats.parsed += 1
    _views(views, tables, row, stats)
    return rows, stats


def _views(views: list, tables: dict, row, stats: Stats) -> None:
    """View columns, views on views in as many passes as they are deep; what never resolves is skipped."""
    while views:
        rest = []
        for view, given, query, statement in views:
            columns = given or _select_columns(query, tables)
            if columns is None:
                rest.append((view, given, query, statement))
                continue
            tables[view] = columns
            for i, c in enumerate(columns):
                row("column", view, c, i, v="view")
        if len(rest) == len(views):
            break
        views = rest
    for view, _, _, _ in views:
        stats.parsed -= 1
        stats.skipped += 1
        stats.previews.append(f"[unresolved view] {view[1]}")


def _select_columns(query: str, tables: dict) -> list[str] | None:
    """The names of a query's columns, None if a table it expands is unknown."""
    m = re.match(r"\s*select\s+(?:distinct\s+)?(.*?)\s+from\s+(.*)$", query, re.I | re.S)
    if not m:
        return None
    try:
        found = sqltext.lineage(query)
    except ValueError:
        return None
    by_name = {t: c for (_, t), c in tables.items()}
    if any(t not in by_name for _, t in found.tables):
        return None
    out: list[str] = []
    for part in items(m[1]):
        if part.strip() == "*" or part.strip().endswith(".*"):
            for _, t in found.tables:
                out += by_name[t]
        elif a := re.search(rf"(?:\bas\s+|\s)({_NAME})\s*$", part, re.I):
            out.append(name(a[1]))
        else:
            out.append(name(part.split(".")[-1]))
    return out


def ddl_catalog(files: DataFrame, default_namespace: str | None = None) -> DataFrame:
    """Catalog rows of each dump of files (file, lines), with one ``stats`` row each: ordinal is the total, value ``parsed,skipped,dewrapped``."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            data: list[tuple] = []
            for file, text in zip(pdf.file, pdf.lines, strict=True):
                rows, stats = parse(text, default_namespace)
                data += [(file, *r) for r in rows]
                data.append((file, "stats", None, None, None, stats.total, None, None, None, None, f"{stats.parsed},{stats.skipped},{str(stats.dewrapped).lower()}"))
                data += [(file, "skipped", None, None, None, i, None, None, None, None, p) for i, p in enumerate(stats.previews)]
            yield pd.DataFrame(data, columns=columns).astype({"ordinal": "Int32"})

    return files.where("lines is not null").select("file", "lines").mapInPandas(run, SCHEMA)


def schema_tag(argument: str) -> tuple[str | None, str]:
    """(namespace, path) of ``namespace=path`` or a bare path."""
    tag, sep, path = argument.partition("=")
    return (tag.strip().lower(), path) if sep and re.fullmatch(r"\w+", tag.strip()) else (None, argument)


def check_namespaces(arguments: list[str], default: str | None) -> None:
    """Raise if dumps are tagged with schemas but no default namespace tells where bare names belong."""
    if any(schema_tag(a)[0] for a in arguments) and not default:
        raise ValueError("dumps with schemas need a default namespace")
