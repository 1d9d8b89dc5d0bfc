"""Dataflow over control-flow graphs, procedure by procedure: reaching definitions, live and dead variables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "file string, object string, proc string, block int, fact string, var string, line int"


def reaching(edges: list[tuple[int, int]], blocks: list[int], gen: dict[int, dict[str, int]]) -> dict[int, set[tuple[str, int]]]:
    """block -> (var, line) of definitions that reach its start. gen: the last definition of each variable in a block."""
    before: dict[int, list[int]] = {}
    for a, b in edges:
        before.setdefault(b, []).append(a)
    into: dict[int, set[tuple[str, int]]] = {b: set() for b in blocks}
    out = {b: set(gen.get(b, {}).items()) for b in blocks}
    changed = True
    while changed:
        changed = False
        for b in blocks:
            new = set().union(*(out[a] for a in before.get(b, ()) if a in out))
            if new != into[b]:
                into[b], changed = new, True
                out[b] = set(gen.get(b, {}).items()) | {(v, n) for v, n in new if v not in gen.get(b, {})}
    return into


def live(edges: list[tuple[int, int]], blocks: list[int], use: dict[int, set[str]], kill: dict[int, set[str]]) -> dict[int, set[str]]:
    """block -> variables that are live at its end. use: those used before any definition in the block."""
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    start = {b: set(use.get(b, ())) for b in blocks}
    end: dict[int, set[str]] = {b: set() for b in blocks}
    changed = True
    while changed:
        changed = False
        for b in reversed(blocks):
            new = set().union(*(start[s] for s in after.get(b, ()) if s in start))
            if new != end[b]:
                end[b], changed = new, True
                start[b] = use.get(b, set()) | (new - kill.get(b, set()))
    return end


def procedure_facts(rows: list[tuple]) -> list[tuple]:
    """(block, fact, var, line) of one procedure, from its (tag, name, kind, value, block, line) rows in order."""
    blocks = sorted({b for t, _, _, _, b, _ in rows if t == "block"})
    edges = [(int(n), int(v)) for t, n, _, v, _, _ in rows if t == "edge"]
    gen: dict[int, dict[str, int]] = {}
    use: dict[int, set[str]] = {}
    out: set[tuple] = {(b, "unreachable", None, None) for t, _, k, _, b, _ in rows if t == "block" and k == "unreachable"}
    pending: dict[tuple[int, str], int] = {}
    steps = sorted((r for r in rows if r[0] in ("def", "use") and r[4] is not None), key=lambda r: (r[5], r[0] == "def"))
    for tag, var, _, _, block, line in steps:
        if tag == "use":
            pending.pop((block, var), None)
            if var not in gen.get(block, {}):
                use.setdefault(block, set()).add(var)
            continue
        if (block, var) in pending:
            out.add((block, "overwritten", var, pending[(block, var)]))
        gen.setdefault(block, {})[var] = line
        pending[(block, var)] = line
    out |= {(b, "exposed", v, None) for b, names in use.items() for v in names}
    out |= {(b, "reaching", v, n) for b, found in reaching(edges, blocks, gen).items() for v, n in found}
    out |= {(b, "live", v, None) for b, found in live(edges, blocks, use, {b: set(g) for b, g in gen.items()}).items() for v in found}
    return sorted(out, key=str)


def dataflow(files: DataFrame) -> DataFrame:
    """(file, object, proc, block, fact, var, line) of each procedure of the scripts of files (file, lines).

    fact: ``reaching`` (a definition that reaches the block), ``live`` (at its end),
    ``exposed`` (used before any definition in the block), ``overwritten`` (a definition
    that its block replaces before any use), ``unreachable`` (a block). A procedure lies
    within one file, so nothing is shuffled. NULL texts give no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from lodestone.sources.script import facts

        for pdf in batches:
            rows: list[tuple] = []
            for file, text in zip(pdf.file, pdf.lines, strict=True):
                procs: dict[tuple, list[tuple]] = {}
                for tag, object_, proc, line, name, kind, value, block in facts(text):
                    if tag in ("def", "use", "block", "edge"):
                        procs.setdefault((object_, proc), []).append((tag, name, kind, value, block, line))
                rows += [(file, o, p, *r) for (o, p), own in procs.items() for r in procedure_facts(own)]
            out = pd.DataFrame(rows, columns=["file", "object", "proc", "block", "fact", "var", "line"])
            yield out.astype({"block": "Int32", "line": "Int32"})

    return files.where("lines is not null").select("file", "lines").mapInPandas(run, RESULT)


def dead_variables(facts: DataFrame) -> DataFrame:
    """(file, object, proc, var, kind): locals that are never read, parameters that are not used."""
    key = ["file", "object", "proc_name", "name"]
    used = facts.where("tag = 'use'").select(*key).distinct()
    made = facts.where("tag = 'def' and kind in ('local_var', 'param')").select(*key, F.when(F.col("kind") == "param", "unused_param").otherwise("never_read").alias("kind")).distinct()
    return made.join(used, key, "left_anti").select("file", "object", F.col("proc_name").alias("proc"), F.col("name").alias("var"), "kind")
