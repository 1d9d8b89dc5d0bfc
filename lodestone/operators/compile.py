"""Compiled forms of script procedures: instruction graphs, their shapes, loops, merge points and SSA.

A procedure is small and lies in one file, so a task compiles the files that it reads;
nothing is shuffled but the counts that a query asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

RESULT = "file string, object string, proc string, tag string, block int, line int, name string, version int, args string"
_OPS = ("def", "call", "sql", "use")


def order(edges: list[tuple[int, int]], entry: int = 0) -> tuple[list[int], set[tuple[int, int]]]:
    """(blocks in reverse postorder, back edges) of what the entry reaches, by a depth-first walk without recursion."""
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    post, back, state = [], set(), {entry: 1}
    stack = [(entry, iter(after.get(entry, ())))]
    while stack:
        at, rest = stack[-1]
        for b in rest:
            if state.get(b) == 1:
                back.add((at, b))
            elif b not in state:
                state[b] = 1
                stack.append((b, iter(after.get(b, ()))))
                break
        else:
            state[at] = 2
            post.append(at)
            stack.pop()
    return post[::-1], back


def loops(edges: list[tuple[int, int]], entry: int = 0) -> dict[int, set[int]]:
    """header -> blocks of its loop, the header included: what reaches the source of a back edge without passing the header."""
    blocks, back = order(edges, entry)
    known = set(blocks)
    before: dict[int, list[int]] = {}
    for a, b in edges:
        if a in known:
            before.setdefault(b, []).append(a)
    out: dict[int, set[int]] = {}
    for tail, header in sorted(back):
        body = out.setdefault(header, {header})
        todo = [tail]
        while todo:
            b = todo.pop()
            if b not in body:
                body.add(b)
                todo += before.get(b, ())
    return out


def merge_points(edges: list[tuple[int, int]], entry: int = 0) -> set[int]:
    """The reachable blocks that several ways lead to, back edges aside."""
    blocks, back = order(edges, entry)
    known, n = set(blocks), {}
    for a, b in set(edges) - back:
        if a in known:
            n[b] = n.get(b, 0) + 1
    return {b for b, k in n.items() if k > 1}


def ssa(edges: list[tuple[int, int]], steps: dict[int, list[tuple[str, str]]], entry: int = 0) -> tuple[dict[int, list[tuple[str, str, int]]], dict[int, dict[str, tuple[int, dict[int, int]]]]]:
    """(block -> (def or use, variable, version) in order, block -> variable -> (version, predecessor -> version)).

    steps: block -> ("def" or "use", variable) in order. Values are looked up on demand
    through the predecessors, so dominators are not needed; a merge gets a phi when a
    value is asked for through it, and one whose operands are all the same or itself is
    taken away again. Version 0 is the value at the entry. Blocks that the entry doesn't
    reach take no part.
    """
    blocks, _ = order(edges, entry)
    known = set(blocks)
    before: dict[int, list[int]] = {b: [] for b in blocks}
    for a, b in dict.fromkeys(edges):
        if a in known:
            before[b].append(a)
    last: dict[str, int] = {}
    at_end: dict[tuple[int, str], int] = {}  # last definition of a block
    at_start: dict[tuple[int, str], int] = {}
    phis: dict[tuple[int, str], tuple[int, dict[int, int]]] = {}
    same: dict[tuple[str, int], int] = {}  # a version that is another

    def fresh(v: str) -> int:
        last[v] = last.get(v, 0) + 1
        return last[v]

    numbered: dict[int, list[tuple[str, str, int]]] = {}
    for b in blocks:
        row = []
        for kind, v in steps.get(b, ()):
            if kind == "def":
                at_end[(b, v)] = fresh(v)
                row.append(("def", v, at_end[(b, v)]))
            else:
                row.append(("use", v, at_end.get((b, v), -1)))
        numbered[b] = row

    def start_of(b: int, v: str) -> None:
        """Give (b, v) a value at its start, and all that it needs: a work list in place of recursion."""
        todo = [b]
        while todo:
            x = todo[-1]
            if (x, v) in at_start:
                todo.pop()
                continue
            ways = before[x]
            if not ways and x == entry:
                at_start[(x, v)] = 0
            elif len(ways) == 1 and x != entry:
                p = ways[0]
                if (p, v) in at_end:
                    at_start[(x, v)] = at_end[(p, v)]
                elif (p, v) in at_start:
                    at_start[(x, v)] = at_start[(p, v)]
                else:
                    todo.append(p)
            else:
                phis[(x, v)] = (fresh(v), {})
                at_start[(x, v)] = phis[(x, v)][0]
                todo.pop()
                todo += [p for p in ways if (p, v) not in at_end and (p, v) not in at_start]

    for b in blocks:
        for _, v, version in numbered[b]:
            if version == -1:
                start_of(b, v)
    pending = True
    while pending:  # operands may ask for values further up
        pending = False
        for (b, v), (_, operands) in list(phis.items()):
            for p in before[b]:
                if p not in operands:
                    if (p, v) not in at_end:
                        start_of(p, v)
                    operands[p] = at_end.get((p, v), at_start.get((p, v)))
                    pending = True
            if b == entry and -1 not in operands:
                operands[-1] = 0  # the way in
                pending = True

    def find(v: str, n: int) -> int:
        while (v, n) in same:
            n = same[(v, n)]
        return n

    changed = True
    while changed:
        changed = False
        for key, (version, operands) in list(phis.items()):
            others = {find(key[1], n) for n in operands.values()} - {version}
            if len(others) == 1:
                same[(key[1], version)] = others.pop()
                del phis[key]
                changed = True
    uses = {b: [(k, v, find(v, at_start[(b, v)] if n == -1 else n)) for k, v, n in row] for b, row in numbered.items()}
    merged: dict[int, dict[str, tuple[int, dict[int, int]]]] = {}
    for (b, v), (version, operands) in phis.items():
        merged.setdefault(b, {})[v] = (version, {p: find(v, n) for p, n in operands.items()})
    return uses, merged


def shape(instructions: list[tuple[str, str | None]]) -> str:
    """A digest of (operation, name) that doesn't depend on the names: each is its place among the first occurrences."""
    places: dict[str, int] = {}
    text = ";".join(f"{op} {places.setdefault(n, len(places)) if n is not None else ''}" for op, n in instructions)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def compiled(rows: list[tuple]) -> list[tuple]:
    """(tag, block, line, name, version, args) of one procedure, from its (tag, name, kind, value, block, line) rows in order.

    tag: ``instr`` (name: operation, args: its names), ``loop`` (args: the blocks),
    ``merge``, ``def``, ``use`` and ``phi`` (args: predecessor:version), ``shape``.
    """
    edges = [(int(n), int(v)) for t, n, _, v, _, _ in rows if t == "edge"]
    out: list[tuple] = []
    steps: dict[int, list[tuple[str, str]]] = {}
    lines: dict[int, list[int]] = {}
    listing: list[tuple[str, str | None]] = []
    kept = sorted((r for r in rows if r[0] in _OPS and r[4] is not None), key=lambda r: (r[4], r[5], r[0] == "def"))
    for tag, name, kind, value, block, line in kept:
        if tag in ("def", "use"):
            steps.setdefault(block, []).append((tag, name))
            lines.setdefault(block, []).append(line)
        op = f"{tag}:{kind}" if tag in ("def", "use") else f"sql:{name}" if tag == "sql" else f"call/{value}"
        listing.append((op, None if tag == "sql" else name))
        out.append(("instr", block, line, op, None, None if tag == "sql" else name))
    after: dict[int, int] = {}
    for a, _ in edges:
        after[a] = after.get(a, 0) + 1
    blocks, _ = order(edges)
    out += [("instr", b, None, ("exit", "jump", "branch")[min(after.get(b, 0), 2)], None, None) for b in blocks]
    for header, body in loops(edges).items():
        out.append(("loop", header, None, None, None, ",".join(map(str, sorted(body)))))
    out += [("merge", b, None, None, None, None) for b in sorted(merge_points(edges))]
    uses, phis = ssa(edges, steps)
    for b, row in uses.items():
        out += [(k, b, line, v, n, None) for (k, v, n), line in zip(row, lines.get(b, ()), strict=True)]
    for b, found in phis.items():
        out += [("phi", b, None, v, n, ",".join(f"{p}:{o}" for p, o in sorted(operands.items()))) for v, (n, operands) in found.items()]
    listing += [("edge", f"{a}>{b}") for a, b in sorted(edges)]
    out.append(("shape", None, None, shape(listing), None, None))
    return out


def compile_scripts(files: DataFrame) -> DataFrame:
    """The rows of ``compiled`` of each procedure of the scripts of files (file, lines). NULL and empty texts give none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from lodestone.sources.script import facts

        for pdf in batches:
            rows: list[tuple] = []
            for file, text in zip(pdf.file, pdf.lines, strict=True):
                procs: dict[tuple, list[tuple]] = {}
                for tag, object_, proc, line, name, kind, value, block in facts(text):
                    if proc is not None and tag in ("def", "use", "call", "sql", "edge", "block"):
                        procs.setdefault((object_, proc), []).append((tag, name, kind, value, block, line))
                rows += [(file, o, p, *r) for (o, p), own in procs.items() for r in compiled(own)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield out.astype({"block": "Int32", "line": "Int32", "version": "Int32"})

    return files.where("lines is not null").select("file", "lines").mapInPandas(run, RESULT)
