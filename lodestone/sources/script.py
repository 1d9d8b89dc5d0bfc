"""Facts of script sources: procedures, definitions and uses of variables, calls, embedded SQL, control flow.

A file is the unit of work: one task reads it whole and emits rows of one relation,
told apart by their tag. Syntax errors don't stop it; what can't be read gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, tag string, object string, proc_name string, line int, name string, kind string, value string, block int"
# Words that are no variables or calls.
_WORDS = frozenset(
    "if then else elseif end for to step next do while until loop choose case is try catch finally return exit continue and or not xor true false this parent super public private protected function subroutine event on type from within global shared forward variables prototypes ref readonly create destroy using call goto halt".split()
)
_TYPES = frozenset("any blob boolean byte char character date datetime dec decimal double int integer long longlong longptr real string time uint ulong unsignedint unsignedinteger unsignedlong".split())
_PART = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:~.|[^"~\n])*"?|'(?:~.|[^'~\n])*'?|&[ \t]*(?=\n)|\n|[^"'/&\n]+|.""", re.S)
_HEADER = re.compile(r"(?:HA)?\$PBExport(?:Header|Comments)\$")
_SQL = re.compile(r"(?:select|insert|update|delete|execute|declare|open|fetch|close|commit|rollback|connect|disconnect)\b(?!\s*[.(=])", re.I)
_DML = re.compile(r"(?:select|insert|update|delete)\b", re.I)
_NAME = r"[A-Za-z_][\w$#%-]*"
_PROC = re.compile(rf"(?:(?:public|private|protected|global)\s+)?(?:(function)\s+(\S+)\s+|(subroutine)\s+|(event)\s+(?:type\s+\S+\s+)?)({_NAME}(?:::{_NAME})?)\s*(?:\((.*)\))?\s*$", re.I | re.S)
_ON = re.compile(r"on\s+(\S+)$", re.I)
_LOCAL = re.compile(rf"(?:{'|'.join(sorted(_TYPES, key=len, reverse=True))})(?:\{{\d+\}})?\s+({_NAME}.*)$", re.I | re.S)
_OWN_TYPE = re.compile(rf"({_NAME})\s+({_NAME}(?:\s*,\s*{_NAME})*)$")
_ASSIGN = re.compile(rf"({_NAME})(?:\[[^\]]*\])?\s*(\+=|-=|\*=|/=|=)(?!=)\s*(.*)$", re.S)
_STEP = re.compile(rf"({_NAME})(\+\+|--)$")
_CALL = re.compile(rf"(?:((?:{_NAME}\.)+))?({_NAME})\s*\(")
_VARIABLE = re.compile(rf"(?<![\w.:$])({_NAME})(?!\s*\()(?![\w$#%-])(?!\.)")
_HOST = re.compile(r":\s*([A-Za-z_]\w*)")
_INTO = re.compile(r"\binto\b(.*?)(?:\bfrom\b|;|\Z)", re.I | re.S)


def logical_lines(text: str) -> list[tuple[int, str]]:
    """(line, statement) without comments, header lines and continuations; string literals stay, SQL runs to its semicolon."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    line, began, sql, last = 1, 1, False, ""  # last: the last sign of the statement so far, so that a long one is joined once
    for m in _PART.finditer(text.replace("\r\n", "\n")):
        got = m.group()
        if got[:2] in ("//", "/*"):
            line += got.count("\n")
        elif got == "\n":
            if parts and parts[-1] == "&":
                parts[-1] = " "
            elif sql and last != ";":
                parts.append(" ")
            else:
                statement = "".join(parts).strip()
                if statement and not _HEADER.match(statement):
                    out.append((began, statement))
                parts.clear()
                sql, last = False, ""
            line += 1
        else:
            filled = got.strip()
            if not last:
                began = line
                sql = bool(_SQL.match(filled))
            last = filled[-1:] or last
            parts.append("&" if got[0] == "&" and len(filled) == 1 else got)
    if (statement := "".join(parts).strip()) and not _HEADER.match(statement):
        out.append((began, statement))
    return out


def bare(statement: str) -> str:
    """A statement without the text of its literals."""
    return re.sub(r""""(?:~.|[^"~])*"?|'(?:~.|[^'~])*'?""", '""', statement)


def variables(expression: str) -> list[str]:
    """The variables of an expression, once each, in order."""
    names = (v.lower() for v in _VARIABLE.findall(bare(expression)))
    return list(dict.fromkeys(v for v in names if v not in _WORDS and v not in _TYPES))


@dataclass
class Flow:
    """The control flow of one procedure while it is read: blocks and edges.

    A block is made when a statement or a merge needs it; behind a return there is none
    until the next statement, which nothing reaches. ``pruned`` are the first blocks of
    branches that a constant condition rules out.
    """

    edges: list[tuple[int, int]] = field(default_factory=list)
    block: int | None = 0
    n: int = 1
    open: list[dict] = field(default_factory=list)
    pruned: list[int] = field(default_factory=list)

    def new(self, *before: int | None) -> int:
        block, self.n = self.n, self.n + 1
        self.edges += [(b, block) for b in dict.fromkeys(before) if b is not None]
        return block

    def merge(self, before: list[int | None]) -> int | None:
        """The block behind ways of which some may not come back; None if none does."""
        return self.new(*before) if any(b is not None for b in before) else None

    def _in(self, *words: str) -> bool:
        """Whether the innermost open statement is one of these; others' ends in broken sources are passed over."""
        return bool(self.open) and self.open[-1]["word"] in words

    @property
    def in_loop(self) -> bool:
        return any(o["word"] in ("for", "do") for o in self.open)

    def enter(self, word: str) -> None:
        """A statement begins: it has a block, even if nothing leads there."""
        if self.block is None and word not in _CLOSING:
            self.block = self.new()

    def step(self, word: str, constant: bool | None = None) -> None:
        """Take one statement, given by its leading word; constant: the value of its condition, if that is one."""
        if word in ("if", "choose", "try"):
            self.open.append({"head": self.block, "ends": [], "else": word == "try", "word": word, "constant": constant})
            self.block = self.new(self.block) if word != "choose" else None
            if word == "if" and constant is False:
                self.pruned.append(self.block)
        elif word in ("elseif", "else", "case", "case else", "catch") and self._in("if", "choose", "try"):
            top = self.open[-1]
            top["ends"].append(self.block)
            top["else"] = top["else"] or word in ("else", "case else")
            self.block = self.new(top["head"])
            if top["constant"] is True:
                self.pruned.append(self.block)
        elif word in ("for", "do"):
            head = self.new(self.block)
            self.open.append({"head": head, "ends": [], "word": word})
            self.block = self.new(head)
        elif word in ("next", "loop") and self._in("for", "do"):
            top = self.open.pop()
            if self.block is not None:
                self.edges.append((self.block, top["head"]))
            self.block = self.new(top["head"], *top["ends"])
        elif word in ("end if", "end choose", "end try") and self._in("if", "choose", "try"):
            top = self.open.pop()
            self.block = self.merge([*top["ends"], self.block] + ([] if top["else"] else [top["head"]]))
        elif word == "exit":
            loop = next((o for o in reversed(self.open) if o["word"] in ("for", "do")), None)
            if loop is not None:
                loop["ends"].append(self.block)
            self.block = None
        elif word == "continue":
            loop = next((o for o in reversed(self.open) if o["word"] in ("for", "do")), None)
            if loop is not None:
                self.edges.append((self.block, loop["head"]))
            self.block = None
        elif word in ("return", "halt"):
            self.block = None

    def states(self) -> list[str]:
        """Per block: reachable, unreachable, or const_unreachable if a constant condition rules it out."""
        after: dict[int, list[int]] = {}
        incoming = [0] * self.n
        for a, b in self.edges:
            after.setdefault(a, []).append(b)
            incoming[b] += 1
        seen = _walk([0], after)
        # A branch ends where another way joins it.
        ruled_out = _walk(self.pruned, {a: [b for b in bs if incoming[b] <= 1] for a, bs in after.items()})
        return ["unreachable" if b not in seen else "const_unreachable" if b in ruled_out else "reachable" for b in range(self.n)]


def _walk(start: list[int], after: dict[int, list[int]]) -> set[int]:
    seen, todo = set(start), list(start)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


# Words that end or divide an open statement.
_CLOSING = frozenset(("elseif", "else", "case", "case else", "catch", "next", "loop", "end if", "end choose", "end try"))


def _constant(condition: str) -> bool | None:
    """The value of a condition that is just TRUE or FALSE."""
    word = condition.strip().strip("()").strip().lower()
    return {"true": True, "false": False}.get(word)


def simple(expression: str) -> tuple[str, str] | None:
    """(kind, text) of an expression that is one variable, call or literal: var, call, string, numeric or boolean."""
    e = expression.strip().rstrip(";").strip().lower()
    if e[:1] in ("'", '"') and bare(e) == '""':
        return "string", ""
    if re.fullmatch(r"-?\d+(?:\.\d+)?", e):
        return "numeric", e
    if e in ("true", "false"):
        return "boolean", e
    if re.fullmatch(_NAME, e) and e not in _WORDS and e not in _TYPES:
        return "var", e
    m = re.match(rf"({_NAME})\s*\(", e)
    if m and m[1] not in _WORDS and e.endswith(")") and _matched(e, m.end()) == len(e) - 1:
        return "call", m[1]
    return None


def _matched(text: str, at: int) -> int:
    """The place of the bracket that closes the one before ``at``, or -1."""
    depth = 1
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return -1


def _word(text: str) -> str:
    low = re.sub(r"\s+", " ", bare(text).lower())
    if m := re.match(r"end (?:if|choose|try)$", low):
        return m.group()
    if low.startswith("if ") and not low.endswith(" then"):
        return ""
    return "case else" if low == "case else" else re.match(r"\w*", low).group()


def facts(text: str) -> Iterator[tuple]:
    """(tag, object, proc_name, line, name, kind, value, block) of one source text."""
    object_ = proc = None
    flow, in_prototypes, scope, began = Flow(), False, None, 0
    for line, raw in logical_lines(text):
        low = raw.lower()
        if m := re.match(r"(?:global\s+)?type\s+(\S+)\s+from\s+(\S+)", raw, re.I):
            if object_ is None:
                object_ = m[1].lower()
            yield "type", object_, None, line, m[1].lower(), None, m[2].lower(), None
            continue
        if re.match(r"(?:forward|type)\s+prototypes$", low):
            in_prototypes = True
            continue
        if re.match(r"end\s+prototypes$", low):
            in_prototypes = False
            continue
        if in_prototypes:
            continue
        if m := re.match(r"(type|global|shared)\s+variables$", low):
            scope = "instance" if m[1] == "type" else m[1]
            continue
        if re.match(r"end\s+variables$", low):
            scope = None
            continue
        if scope and proc is None:
            yield from (("var", object_, None, line, name, scope, kind, None) for name, kind in declared(raw))
            continue
        if proc is None:
            m = _PROC.match(raw[:-1]) if raw.endswith(";") else None
            on = _ON.match(raw)
            if m or on:
                kind = (m[1] or m[3] or m[4]).lower() if m else "on"
                proc, flow, began = (m[5] if m else on[1]).lower(), Flow(), line
                parameters = [p.split() for p in (m[6] or "").split(",") if p.strip()] if m else []
                yield "proc", object_, proc, line, proc, kind, (m[2] or "").lower() if m else "", None
                for p in parameters:
                    yield "def", object_, proc, line, p[-1].lower(), "param", p[-2].lower() if len(p) > 1 else None, 0
                for i, p in enumerate(parameters):
                    yield "param", object_, proc, line, p[-1].lower(), p[0].lower() if len(p) > 2 else None, str(i), 0
            continue
        if re.match(r"end\s+(?:function|subroutine|event|on)$", low):
            for a, b in flow.edges:
                yield "edge", object_, proc, began, str(a), None, str(b), a
            for b, state in enumerate(flow.states()):
                yield "block", object_, proc, began, str(b), state, None, b
            yield "end", object_, proc, line, proc, None, str(len(flow.edges) - flow.n + 2), None
            proc = None
            continue
        if _SQL.match(raw):
            flow.enter("")
            yield from _sql_facts(object_, proc, line, raw, flow.block)
            if flow.in_loop and _DML.match(raw):
                yield "loop_sql", object_, proc, line, re.match(r"\w+", raw).group().upper(), None, raw, flow.block
            continue
        for statement in re.split(r";", bare(raw)) if ";" in bare(raw) and '"' not in raw and "'" not in raw else [raw]:
            yield from _statement_facts(object_, proc, line, statement.strip(), flow)


def declared(raw: str) -> list[tuple[str, str]]:
    """(name, type) of a line that declares variables of built-in or own types."""
    text = re.sub(r"^(?:public|private|protected|privatewrite|protectedwrite|constant|\s)+", "", bare(raw), flags=re.I)
    m = re.match(rf"({_NAME})(?:\{{\d+\}})?\s+({_NAME}.*)$", text.rstrip(";"), re.S)
    if not m or m[1].lower() in _WORDS:
        return []
    names = (re.match(_NAME, piece.strip()) for piece in re.split(r",(?![^(]*\))", m[2]))
    return [(n.group().lower(), m[1].lower()) for n in names if n]


def _sql_facts(object_: str | None, proc: str, line: int, raw: str, block: int | None) -> Iterator[tuple]:
    word = re.match(r"\w+", raw).group().upper()
    yield "sql", object_, proc, line, word, None, raw, block
    into = _INTO.search(raw) if word != "INSERT" else None
    targets = [v.lower() for v in _HOST.findall(into[1])] if into else []
    for v in targets:
        yield "def", object_, proc, line, v, "sql_into", None, block
    rest = raw if into is None else raw[: into.start(1)] + raw[into.end(1) :]
    for v in dict.fromkeys(v.lower() for v in _HOST.findall(re.sub(r"'[^']*'", "''", rest))):
        yield "use", object_, proc, line, v, "sql_host_var", word, block


def _statement_facts(object_: str | None, proc: str, line: int, text: str, flow: Flow) -> Iterator[tuple]:
    word = _word(text)
    flow.enter(word)
    use = lambda v, kind: ("use", object_, proc, line, v, kind, None, flow.block)
    define = lambda v, kind: ("def", object_, proc, line, v, kind, None, flow.block)
    inner = text
    if word in ("if", "elseif"):
        yield from (use(v, "condition") for v in variables(re.sub(r"^\w+|\bthen$", "", text, flags=re.I)))
    elif word == "choose":
        yield from (use(v, "condition") for v in variables(re.sub(r"^choose\s+case", "", text, flags=re.I)))
    elif word in ("do", "loop"):
        yield from (use(v, "condition") for v in variables(text))
    elif word == "for" and (m := re.match(rf"for\s+({_NAME})\s*=(.*)$", text, re.I | re.S)):
        yield from (use(v, "loop_range") for v in variables(m[2]))
        yield define(m[1].lower(), "for_var")
    elif word == "return":
        yield from (use(v, "return") for v in variables(text[6:]))
        if got := simple(text[6:]):
            yield "returns", object_, proc, line, None, *got, flow.block
    elif word == "" and text[:3].lower() == "if ":
        # On one line: the same flow as the block form.
        condition, _, inner = re.split(r"(\bthen\b)", bare(text), maxsplit=1, flags=re.I) if re.search(r"\bthen\b", bare(text), re.I) else (bare(text), "", "")
        yield from (use(v, "condition") for v in variables(condition[3:]))
        yield from _calls(object_, proc, line, condition[3:], flow)
        flow.step("if", _constant(condition[3:]))
        for k, part in enumerate(re.split(r"\belse\b", inner, maxsplit=1, flags=re.I)):
            if k:
                flow.step("else")
            if part.strip():
                yield from _statement_facts(object_, proc, line, part.strip(), flow)
        flow.step("end if")
        return
    elif m := _LOCAL.match(text):
        for piece in re.split(r",(?![^(]*\))", m[1]):
            name, _, value = piece.partition("=")
            if found := re.match(_NAME, name.strip()):
                yield from (use(v, "rhs") for v in variables(value))
                yield "def", object_, proc, line, found.group().lower(), "local_var", text.split()[0].split("{")[0].lower(), flow.block
                if got := simple(value):
                    yield "assign", object_, proc, line, found.group().lower(), *got, flow.block
    elif (m := _OWN_TYPE.match(text)) and m[1].lower() not in _WORDS and not _WORDS & set(re.split(r"\s*,\s*", m[2].lower())):
        yield from (("def", object_, proc, line, n, "local_var", m[1].lower(), flow.block) for n in re.split(r"\s*,\s*", m[2].lower()))
    elif m := _STEP.match(text):
        yield use(m[1].lower(), "rhs")
        yield define(m[1].lower(), "inc" if m[2] == "++" else "dec")
    elif (m := _ASSIGN.match(text)) and m[1].lower() not in _WORDS:
        yield from (use(v, "rhs") for v in variables(m[3]))
        if m[2] != "=":
            yield use(m[1].lower(), "rhs")
        yield define(m[1].lower(), "assign" if m[2] == "=" else "augassign")
        if m[2] == "=" and "[" not in text[: m.end(1) + 1] and (got := simple(m[3])):
            yield "assign", object_, proc, line, m[1].lower(), *got, flow.block
    yield from _calls(object_, proc, line, inner, flow)
    condition = re.sub(r"^\w+|\bthen$", "", text, flags=re.I) if word == "if" else ""
    flow.step(word, _constant(condition))


def _calls(object_: str | None, proc: str, line: int, text: str, flow: Flow) -> Iterator[tuple]:
    text = bare(text)
    for m in _CALL.finditer(text):
        if m[2].lower() in _WORDS or m[2].lower() in _TYPES:
            continue
        name, arguments = m[2].lower(), _arguments(text, m.end())
        yield "call", object_, proc, line, name, (m[1] or "").rstrip(".").lower() or None, str(len(arguments)), flow.block
        for i, a in enumerate(arguments):
            yield from (("use", object_, proc, line, v, "call_arg", f"{name}:{i}", flow.block) for v in variables(a))
            if got := simple(a):
                yield "argument", object_, proc, line, f"{name}:{i}", *got, flow.block


def _arguments(text: str, at: int) -> list[str]:
    depth, start, out = 1, at, []
    for i in range(at, len(text)):
        c = text[i]
        depth += (c in "([") - (c in ")]")
        if depth == 0 or (c == "," and depth == 1):
            if text[start:i].strip():
                out.append(text[start:i])
            start = i + 1
        if depth == 0:
            break
    return out


def script_facts(files: DataFrame) -> DataFrame:
    """(file, tag, object, proc_name, line, name, kind, value, block) of each script of files (file, lines).

    tag: type, proc, end (value: cyclomatic complexity), var (a variable of the object:
    scope, type), def, use, call, sql, loop_sql (a statement within a loop), edge, block,
    and assign, returns, argument for what is one variable, call or literal. NULL and
    empty texts give no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [(f, t, o, p, n, a, k, v, b) for f, text in zip(pdf.file, pdf.lines, strict=True) for t, o, p, n, a, k, v, b in facts(text)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"line": "Int32", "block": "Int32"})

    return files.where("lines is not null").select("file", "lines").mapInPandas(run, SCHEMA)


def read_sources(spark, path: str, glob: str = "*.sr*") -> DataFrame:
    """(file, lines, sha) of all sources below a directory: a recursive listing filtered by name, texts in UTF-8 with UTF-16 told by its mark."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    text = F.when(F.hex(F.substring("content", 1, 2)) == "FFFE", F.decode(F.expr("substring(content, 3)"), "UTF-16LE")).otherwise(F.decode("content", "UTF-8"))
    return raw.select(F.col("path").alias("file"), text.alias("lines"), F.sha2("content", 256).alias("sha"))
