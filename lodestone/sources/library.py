"""Binary source libraries: a library file is one row of bytes, its sources come out as rows.

A library holds a directory of nodes (a search tree) whose entries point to chains of
data blocks. Each library is read by one task; libraries are read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: block and node sizes, places of the fields, extensions of sources.
BLOCK, NODE = 512, 3072
FIRST_NODE_ANSI, FIRST_NODE_UNICODE = 1024, 1536
LEFT_AT, NEXT_AT, COUNT_AT, ENTRIES_AT = 4, 12, 20, 32
EXTENSIONS = (".srd", ".srs", ".srw", ".sru", ".srf", ".srm", ".srx", ".srj", ".srp", ".srq", ".sra")
HEADER_MARKS = ("HA$PBExportHeader$", "$PBExportHeader$", "$PBExportComments$")


class Library:
    """Random access to the bytes of one library."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"HDR*":
            raise ValueError("no library: the header is missing")
        self.data = data
        self.unicode = data[5:6] == b"\0"

    def text(self, raw: bytes) -> str:
        if self.unicode:
            return raw.decode("utf-16-le", errors="replace").replace("\0", "")
        try:
            return raw.decode("cp1253")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    def number(self, at: int, size: int = 4) -> int:
        return struct.unpack_from("<I" if size == 4 else "<H", self.data, at)[0]

    def entries(self) -> Iterator[tuple[str, int, int]]:
        """(name, place of the data, length of the comment) in the order of the tree; nodes seen twice are passed over."""
        todo: list[tuple[str, int]] = [("node", FIRST_NODE_UNICODE if self.unicode else FIRST_NODE_ANSI)]
        seen: set[int] = set()
        while todo:
            what, at = todo.pop()
            if what == "entries":
                yield from self._node(at)
                continue
            if at == 0 or at in seen:
                continue
            seen.add(at)
            if self.data[at : at + 4] != b"NOD*":
                raise ValueError(f"no node at {at}")
            todo += [("node", self.number(at + NEXT_AT)), ("entries", at), ("node", self.number(at + LEFT_AT))]

    def _node(self, at: int) -> Iterator[tuple[str, int, int]]:
        place = at + ENTRIES_AT
        for _ in range(self.number(at + COUNT_AT, 2)):
            fixed = place + 4 + (8 if self.unicode else 4)
            comment, length = self.number(fixed + 12, 2), self.number(fixed + 14, 2)
            name = self.text(self.data[fixed + 16 : fixed + 16 + length]).rstrip("\0")
            yield name, self.number(fixed), comment
            place = fixed + 16 + length

    def content(self, at: int, comment: int) -> str:
        parts, seen = [], set()
        while at and at not in seen:
            seen.add(at)
            if self.data[at : at + 4] != b"DAT*":
                raise ValueError(f"no data at {at}")
            parts.append(self.data[at + 10 : at + 10 + self.number(at + 8, 2)])
            at = self.number(at + 4)
        return self.text(b"".join(parts))[comment:]


def sources(data: bytes) -> list[tuple[str, str]]:
    """(name, text) of each source in a library's bytes."""
    library = Library(data)
    return [(name, library.content(at, comment)) for name, at, comment in library.entries() if name.lower().endswith(EXTENSIONS)]


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """(library, name, lines, error) of all libraries below a directory; a broken library gives one row with its error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pbl").load(path)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows: list[tuple] = []
            for file, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows += [(file, name, text, None) for name, text in sources(bytes(content))]
                except (ValueError, struct.error) as e:
                    rows.append((file, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["library", "name", "lines", "error"])

    return raw.select("path", "content").mapInPandas(run, "library string, name string, lines string, error string")
