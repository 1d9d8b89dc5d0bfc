"""Source files that do not parse: table-driven parsers from grammars bundled here.

A grammar is text; an LL(1) table is built from it once per process, and a conflict in
it is an error of ours, not of a file. A scanner per language turns a whole file into
terminals (for scripts one per statement, in which comments, strings, continued lines
and brackets are dealt with), a pushdown machine runs over all of them, and the first
terminal that the table has no entry for is the file's error. Files are independent,
so a repository with a third of all rows costs no more than its files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "$"

# The grammars. A line is a rule; lower-case words are terminals, | separates choices, an empty choice is nothing.
SCRIPT = """
File: Skip Block Top
Skip: global_name Skip |
Top: Block Top | global_name Top |
Block: forward Inner end_forward | prototypes Protos end_prototypes | variables Plain end_variables | type Inner end_type | on Body end_on | event Body end_event | function Body end_function | subroutine Body end_subroutine
Inner: Block Inner | Line Inner |
Line: global_name | statement | prototype | event_line
Protos: prototype Protos | event_line Protos | statement Protos |
Plain: statement Plain | global_name Plain |
Body: statement Body | global_name Body | event_line Body | sql Body | Control Body |
Control: if Body Arms end_if | for Body next | do Body loop | choose Body Cases end_choose | try Body Catches end_try
Arms: elseif Body Arms | else Body Arms |
Cases: case Body Cases |
Catches: catch Body Catches |
"""
REPORT = """
File: release Element More
More: Element More |
Element: name ( Inside )
Inside: Part Inside |
Part: name | other | string | ( Inside ) | [ Inside ]
"""
PIPELINE = REPORT.replace("release ", "", 1)
PROJECT = """
File: entry More
More: entry More |
"""
GRAMMARS = {"powerscript": SCRIPT, "datawindow": REPORT, "pipeline": PIPELINE, "project": PROJECT}
# Kinds by extension, header lines, what a merge leaves, entries of a project with their numbers of fields.
KIND_OF_EXTENSION = {"srd": "datawindow", "srp": "pipeline", "srj": "project"}
HEADER = re.compile(r"﻿?(?:(?:HA)?\$PBExportHeader\$|\$PBExportComments\$)")
MERGE = re.compile(r"<{7}(?:\s|$)|={7}\s*$|>{7}(?:\s|$)|\|{7}(?:\s|$)", re.M)
FIELDS = {"EXE": 5, "CMP": 4, "PBD": 3, "OBJ": 3}


@dataclass(frozen=True)
class Token:
    kind: str
    line: int


@dataclass(frozen=True)
class Failure:
    line: int
    found: str
    expected: str


class ScanError(Exception):
    def __init__(self, line: int, found: str) -> None:
        super().__init__(found)
        self.line, self.found = line, found


class Table:
    """The LL(1) table of a grammar."""

    def __init__(self, grammar: str) -> None:
        self.rules: dict[str, list[list[str]]] = {}
        for line in grammar.strip().splitlines():
            name, _, right = line.partition(":")
            self.rules[name.strip()] = [choice.split() for choice in right.split("|")]
        self.start = next(iter(self.rules))
        first: dict[str, set[str]] = {n: set() for n in self.rules}
        nullable: set[str] = set()
        follow: dict[str, set[str]] = {n: set() for n in self.rules}
        follow[self.start].add(END)

        def starts(symbols: list[str]) -> tuple[set[str], bool]:
            out: set[str] = set()
            for s in symbols:
                if s not in self.rules:
                    return out | {s}, False
                out |= first[s]
                if s not in nullable:
                    return out, False
            return out, True

        changed = True
        while changed:
            before = sum(map(len, first.values())) + len(nullable) + sum(map(len, follow.values()))
            for name, choices in self.rules.items():
                for choice in choices:
                    f, empty = starts(choice)
                    first[name] |= f
                    if empty:
                        nullable.add(name)
                    for i, s in enumerate(choice):
                        if s in self.rules:
                            f, empty = starts(choice[i + 1 :])
                            follow[s] |= f | (follow[name] if empty else set())
            changed = before != sum(map(len, first.values())) + len(nullable) + sum(map(len, follow.values()))
        self.entries: dict[tuple[str, str], list[str]] = {}
        for name, choices in self.rules.items():
            for choice in choices:
                f, empty = starts(choice)
                for terminal in f | (follow[name] if empty else set()):
                    if (name, terminal) in self.entries:
                        raise ValueError(f"conflict at {name}, {terminal}")
                    self.entries[(name, terminal)] = choice[::-1]

    def parse(self, tokens: Iterable[Token]) -> Failure | None:
        """None if the grammar derives the tokens, which end with END; else the first that it doesn't."""
        stack = [END, self.start]
        for token in tokens:
            while True:
                top = stack.pop()
                if top == token.kind:
                    break
                choice = self.entries.get((top, token.kind))
                if choice is None:
                    wanted = sorted({t for n, t in self.entries if n == top}) if top in self.rules else [top]
                    return Failure(token.line, token.kind, " ".join(wanted))
                stack.extend(choice)
        return None


@cache
def table(language: str) -> Table:
    return Table(GRAMMARS[language])


def _body(text: str) -> tuple[str, int]:
    """The text without its header lines and with LF line ends; the number of its first line."""
    text = text.replace("\r\n", "\n")
    line = 1
    while HEADER.match(text):
        _, _, text = text.partition("\n")
        line += 1
    return text, line


_SCRIPT_PART = re.compile(
    r"""(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>"(?:~[^\n]|[^"~\n])*"|'(?:~[^\n]|[^'~\n])*')|(?P<nl>\n)|(?P<bad>/\*|["'])|(?P<mark>[;()\[\]&])|(?P<plain>~[^\n]?|[^"'/\n;()\[\]&~]+|/)""", re.S
)
_CLOSES = {")": "(", "]": "["}
_SQL = re.compile(r"(?:select|insert|update|delete)\b", re.I)
# How a statement's words decide its terminal, in this order.
_SCOPE = r"(?:(?:public|private|protected|global)\s+)?"
_OPENERS = tuple(
    (kind, re.compile(pattern, re.I | re.S))
    for kind, pattern in (
        ("end", r"end\s+(?P<word>\w+)$"), ("end", r"(?P<word>end)$"), ("next", r"next$"), ("loop", r"loop(?:\s+(?:while|until)\b.*)?$"), ("forward", r"forward$"), ("prototypes", r"(?:forward|type)\s+prototypes$"),
        ("variables", r"(?:type|shared|global)\s+variables$"), ("type", r"(?:global\s+)?type\s+\S+\s+from\s+\S.*"), ("global_name", r"global\s+\S+\s+\S+$"), ("on", r"on\s+[^\s=(]+$"), ("event", r"event\s+\S.*"),
        ("function", rf"{_SCOPE}function\s+\S.*"), ("subroutine", rf"{_SCOPE}subroutine\s+\S.*"), ("if", r"if\b.*\bthen$"), ("elseif", r"elseif\b.*\bthen$"), ("else", r"else$"), ("for", r"for\s+\S.*"),
        ("do", r"do(?:\s+(?:while|until)\b.*)?$"), ("choose", r"choose\s+case\b.*"), ("case", r"case\b.*"), ("try", r"try$"), ("catch", r"catch\b.*"),
    )
)
_KEYWORD = re.compile(r"(?:end|next|loop|forward|type|shared|global|on|event|public|private|protected|function|subroutine|if|elseif|else|for|do|choose|case|try|catch)\b", re.I)
_END_WORDS = frozenset("forward prototypes variables type on event function subroutine if choose try".split())


def _statement(text: str, ended: bool, alone: bool) -> str:
    """The terminal of a statement, without strings' and comments' contents; ended: by ``;``, alone: on its line."""
    if not _KEYWORD.match(text):
        return "statement"
    for kind, pattern in _OPENERS:
        m = pattern.match(text)
        if not m:
            continue
        if kind == "end":
            word = m["word"].lower()
            return f"end_{word}" if word in _END_WORDS and alone and not ended else "stray_end"
        if kind in ("next", "loop"):
            return kind if alone and not ended else "stray_end"
        if kind in ("function", "subroutine"):
            return (kind if alone else "stray_header") if ended else "prototype"
        if kind == "event":
            return (kind if alone else "stray_header") if ended else "event_line"
        return kind
    return "statement"


def scan_script(text: str) -> Iterator[Token]:
    """The terminals of a script: one per statement."""
    text, line = _body(text)
    parts: list[str] = []
    brackets: list[str] = []
    state = {"first": line, "on_line": 0}
    # n_filled counts the parts that aren't blank, so that a long statement is joined once, at its end.
    sql, n_filled = False, 0

    def put(part: str) -> None:
        nonlocal n_filled
        parts.append(part)
        n_filled += not part.isspace()

    def continued() -> bool:
        """Whether the last sign is a continuation; it is taken away then."""
        nonlocal n_filled
        at = len(parts)
        while at and (not parts[at - 1] or parts[at - 1].isspace()):
            at -= 1
        if not at or not parts[at - 1].rstrip().endswith("&"):
            return False
        held = parts[at - 1].rstrip()[:-1]
        del parts[at - 1 :]
        n_filled -= 1
        if held:
            put(held)
        return True

    def close(ended: bool, more: bool) -> Iterator[Token]:
        nonlocal sql, n_filled
        statement = "".join(parts).strip() if n_filled else ""
        parts.clear()
        n_filled = 0
        if not statement:
            return
        if brackets:
            raise ScanError(state["first"], "open bracket")
        alone = state["on_line"] == 0 and not more
        kind = "sql" if sql else _statement(statement, ended, alone)
        sql = False
        state["on_line"] += 1
        yield Token(kind, state["first"])

    end, size, at_start = 0, len(text), True
    while end < size:
        if at_start and not n_filled:
            state["first"] = line
        if at_start and text[end] in "<=>|" and MERGE.match(text, end):
            raise ScanError(line, "merge conflict")
        m = _SCRIPT_PART.match(text, end)
        end = m.end()
        part, at_start = m.lastgroup, False
        if part == "note":
            n = m.group().count("\n")
            put(" ")
            if n and not sql and not brackets:
                yield from close(False, False)
                state["on_line"] = 0
            line += n
        elif part == "text":
            put('""')
        elif part == "bad":
            raise ScanError(line, "open comment" if m.group() == "/*" else "open string")
        elif part == "mark":
            mark = m.group()
            if mark in "([":
                brackets.append(mark)
            elif mark in ")]":
                if not brackets or brackets.pop() != _CLOSES[mark]:
                    raise ScanError(line, "unexpected bracket")
            if mark == ";":
                if sql:
                    if not _ENDS_LINE.match(text, end):
                        put(";")
                        continue
                    yield from close(True, False)
                else:
                    yield from close(True, not _ENDS_LINE.match(text, end))
                    if brackets:
                        raise ScanError(line, "open bracket")
                continue
            put(mark)
        elif part == "nl":
            if sql:
                put(" ")
            elif continued():
                put(" ")
            else:
                yield from close(False, False)
                if brackets:
                    raise ScanError(line, "open bracket")
                state["on_line"] = 0
            line += 1
            at_start = True
        else:
            if not sql and not n_filled and _SQL.match(m.group().lstrip()):
                sql = True
            put(m.group())
    if sql:
        raise ScanError(state["first"], "open SQL")
    if continued():
        raise ScanError(line, "continued line")
    yield from close(False, False)
    yield Token(END, line)


#: From a place on: nothing more on the line but blanks and comments.
_ENDS_LINE = re.compile(r"(?:[^\S\n]|/\*[^\n]*?\*/)*(?://|/\*|\n|\Z)")


_REPORT_PART = re.compile(r'(?P<space>\s+)|(?P<string>"(?:~.|[^"~])*")|(?P<bad>")|(?P<mark>[()\[\]])|(?P<name>[A-Za-z_][\w.]*)|(?P<other>~.|[^\s"()\[\]~A-Za-z_]+|.)', re.S)
_RELEASE = re.compile(r"\s*release\s+\d+(?:\.\d+)?\s*;", re.I)


def scan_report(text: str, release: bool = True) -> Iterator[Token]:
    """The terminals of a datawindow (with release) or a pipeline."""
    text, line = _body(text)
    end, depth = 0, 0
    if release and (m := _RELEASE.match(text)):
        yield Token("release", line)
        end = m.end()
        line += m.group().count("\n")
    size = len(text)
    while end < size:
        if (end == 0 or text[end - 1] == "\n") and text[end] in "<=>|" and MERGE.match(text, end):
            raise ScanError(line, "merge conflict")
        m = _REPORT_PART.match(text, end)
        end = m.end()
        part, got = m.lastgroup, m.group()
        if part == "bad":
            raise ScanError(line, "open string")
        if part == "mark":
            depth += 1 if got in "([" else -1
            yield Token(got, line)
        elif part != "space":
            yield Token(part, line)
        line += got.count("\n")
    yield Token(END, line)


def scan_project(text: str) -> Iterator[Token]:
    """The terminals of a project: an entry per line."""
    text, line = _body(text)
    for row in text.split("\n"):
        if row.strip():
            tag, colon, rest = row.partition(":")
            fields = rest.split(",")
            yield Token("entry" if colon and len(fields) == FIELDS.get(tag) and fields[-1].strip() else "bad entry", line)
        line += 1
    yield Token(END, line)


def first_error(text: str, language: str) -> Failure | None:
    """None if the whole text is valid in the language, else its first error that nothing recovers."""
    tokens = scan_script(text) if language == "powerscript" else scan_project(text) if language == "project" else scan_report(text, language == "datawindow")
    try:
        return table(language).parse(tokens)
    except ScanError as e:
        return Failure(e.line, e.found, "")


def language_of(kind: Column, file: Column) -> Column:
    """The kind of the object, or by the file's extension in any case where it is NULL."""
    extension = F.lower(F.regexp_extract(file, r"\.(\w+)\s*$", 1))
    by_extension = F.lit("powerscript")
    for ext, language in KIND_OF_EXTENSION.items():
        by_extension = F.when(extension == ext, language).otherwise(by_extension)
    return F.coalesce(kind, by_extension)


def with_language(files: DataFrame, objects: DataFrame) -> DataFrame:
    """``files`` with ``language``: the kind that objects gives the file, the least of several, else by extension."""
    kinds = objects.groupBy("file").agg(F.min(F.lower(F.trim("kind"))).alias("kind"))
    known = F.when(F.col("kind").isin(*GRAMMARS), F.col("kind"))
    return files.drop("kind", "language").join(kinds, "file", "left").withColumn("language", language_of(known, F.col("file"))).drop("kind")


def check_files(files: DataFrame) -> DataFrame:
    """(file, language, valid, line, found, expected) of each file with non-NULL lines.

    files: (file, lines, language). An empty text is not valid: it has no block. NULL
    texts are left out; equal texts are judged each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [first_error(t.as_py(), k.as_py()) for t, k in zip(batch.column("lines"), batch.column("language"), strict=True)]
            columns = [
                batch.column("file"), batch.column("language"), pa.array([e is None for e in errors], pa.bool_()), pa.array([e and e.line for e in errors], pa.int32()),
                pa.array([e and e.found for e in errors], pa.string()), pa.array([e and e.expected for e in errors], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "language", "valid", "line", "found", "expected"])

    return files.where("lines is not null").select("file", "lines", "language").mapInArrow(run, "file string, language string, valid boolean, line int, found string, expected string")


def rates(checked: DataFrame) -> DataFrame:
    """(repository, language, n_files, n_invalid, rate) of the result of ``check_files``."""
    repository = F.split_part("file", F.lit("/"), F.lit(1)).alias("repository")
    counts = checked.groupBy(repository, "language").agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return counts.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
