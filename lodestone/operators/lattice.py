"""Formal concepts of an incidence relation, group by group."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    import pandas as pd


def concepts(incidence: dict[str, frozenset[str]], attributes: list[str]) -> list[tuple[frozenset[str], frozenset[str]]]:
    """All formal concepts (extent, intent): intents are closed under intersection, so each object's row meets all intents found so far."""
    everything = frozenset(attributes)
    intents = {everything}
    for row in incidence.values():
        intents |= {row & other for other in intents}
    found = [(frozenset(g for g, row in incidence.items() if intent <= row), intent) for intent in intents]
    return sorted(found, key=lambda c: (-len(c[0]), sorted(c[1])))


def covers(found: list[tuple[frozenset[str], frozenset[str]]]) -> list[tuple[int, int]]:
    """(upper, lower) neighbours: the least extents that contain a concept's."""
    out = []
    for lower, (extent, _) in enumerate(found):
        above = [(len(e), i) for i, (e, _) in enumerate(found) if extent < e]
        least: list[frozenset[str]] = []
        for _, i in sorted(above):
            if not any(e < found[i][0] for e in least):
                least.append(found[i][0])
                out.append((i, lower))
    return sorted(out)


def lattice(incidence: DataFrame) -> DataFrame:
    """(scope, concept, extent, intent, upper): the concepts of each scope with the numbers of those right above.

    incidence: (scope, object, attribute), distinct or not; NULLs are left out. The
    number of concepts can be exponential in a scope's attributes, so a scope is meant
    to be a module of the size that people look at; scopes run in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        rows = {g: frozenset(a) for g, a in pdf.groupby("object")["attribute"]}
        found = concepts(rows, sorted(set(pdf.attribute)))
        above: dict[int, list[int]] = {}
        for upper, lower in covers(found):
            above.setdefault(lower, []).append(upper)
        data = [(pdf["scope"].iloc[0], i, sorted(e), sorted(t), above.get(i, [])) for i, (e, t) in enumerate(found)]
        return pd.DataFrame(data, columns=["scope", "concept", "extent", "intent", "upper"])

    rows = incidence.where("scope is not null and object is not null and attribute is not null").select("scope", "object", "attribute").distinct()
    return rows.groupBy("scope").applyInPandas(run, "scope string, concept int, extent array<string>, intent array<string>, upper array<int>")
