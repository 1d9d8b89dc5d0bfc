"""Encoding of whole texts with a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer over bytes whose states are
made only when a text first reaches them. It rests on two facts about BPE: each
prefix of a piece has one last token, and a sequence of tokens is the encoding of its
bytes exactly if every two neighbours stay apart when merged alone. A state holds the
starts from which a token may still grow, each with the tokens that are not settled
before it; what all of them share is settled and emitted. Tokens have a greatest
length, so the lookahead and the number of states are bounded, and a piece of any
length takes time linear in it.

Decoding feeds the tokens' bytes to an incremental UTF-8 state machine, so a
character may be spread over tokens.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the public pattern that cuts a text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries of the memo of pieces and of the transducer's table, after which each starts anew; results don't depend on them.
PIECES, TRANSITIONS, LONGEST_PIECE = 200_000, 300_000, 64


class Transducer:
    """bytes of one piece -> token ids, determinised as it is used."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        step: dict[int, int] = {}  # node << 8 | byte -> node
        token, inner = [-1], [False]
        for piece, rank in ranks.items():
            node = 0
            for byte in piece:
                nxt = step.get(node << 8 | byte)
                if nxt is None:
                    nxt = step[node << 8 | byte] = len(token)
                    token.append(-1)
                    inner.append(False)
                inner[node] = True
                node = nxt
            token[node] = rank
        self.step, self.token, self.inner = step, token, inner
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self, keep: tuple | None = None) -> int:
        """Forget all states but the first and ``keep``, whose number is returned."""
        #: A state: for each live start (node in the trie, token before it, unsettled tokens before it); the last is the present place.
        start = ((0, -1, ()),)
        self.states, self.number, self.table = [start], {start: 0}, {}
        if keep is None or keep == start:
            return 0
        self.states.append(keep)
        self.number[keep] = 1
        return 1

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank, used on two tokens at a time."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        got = self.whole.get(token)
        if got is None:
            got = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return got

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged."""
        if left < 0:
            return self.stands(right)
        got = self.apart.get((left, right))
        if got is None:
            if len(self.apart) > 4 * TRANSITIONS:
                self.apart.clear()
            got = self.apart[(left, right)] = self.stands(right) and self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, last, tail = [], -1, ()
        for node, before, pending in self.states[state]:
            node = self.step.get(node << 8 | byte)
            if node is None:
                continue
            t = self.token[node]
            if t >= 0 and last < 0 and self.neighbours(before, t):
                last, tail = t, (*pending, t)
            if self.inner[node]:
                live.append((node, before, pending))
        live.append((0, last, tail))
        shortest = min(len(p) for _, _, p in live)
        settled = 0
        while settled < shortest and all(p[settled] == tail[settled] for _, _, p in live):
            settled += 1
        out = tail[:settled]
        key = tuple((n, b, p[settled:]) for n, b, p in live)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        self.table[state << 8 | byte] = (number, out)
        return number, out

    def encode(self, data: bytes) -> list[int]:
        state, ids, table = 0, [], self.table
        for byte in data:
            got = table.get(state << 8 | byte)
            if got is None:
                if len(table) >= TRANSITIONS:  # also within a piece, of any length
                    state = self.reset(self.states[state])
                    table = self.table
                got = self._advance(state, byte)
            state, out = got
            if out:
                ids.extend(out)
        ids.extend(self.states[state][-1][2])
        return ids


class Encoder:
    """text -> ids and back, for one vocabulary of ranks."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode_into(self, text: str, ids: array) -> None:
        memo = self.memo
        for m in self.pieces.finditer(text):
            piece = m.group()
            got = memo.get(piece)
            if got is None:
                got = tuple(self.transducer.encode(piece.encode("utf-8")))
                if len(piece) <= LONGEST_PIECE:
                    if len(memo) >= PIECES:
                        memo.clear()
                    memo[piece] = got
            ids.extend(got)

    def encode(self, text: str) -> list[int]:
        ids = array("i")
        self.encode_into(text, ids)
        return ids.tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        of = self.transducer.bytes_of
        return "".join(machine.decode(of[i]) for i in ids) + machine.decode(b"", final=True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The process's encoder of a vocabulary; a Python worker compiles it once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", path: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """``df`` without ``text`` and with the column ``ids``: the token ids of each text, special tokens' strings being ordinary text.

    With count_only, ``ids`` is the number of tokens (int). NULL and empty texts give
    the empty list (0). A column ``ids`` of ``df`` is replaced. Rows are independent:
    nothing is shuffled, and texts of any length are encoded whole.
    """
    keep = [f for f in df.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*keep, T.StructField(ids, T.IntegerType() if count_only else T.ArrayType(T.IntegerType(), False), True)])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for value in batch.column(text):
                value = value.as_py()
                if value:
                    coder.encode_into(value, flat)
                offsets.append(len(flat))
            ends = pa.array(offsets, pa.int32())
            if count_only:
                out = pa.array([b - a for a, b in zip(offsets, offsets[1:])], pa.int32())
            else:
                out = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, out], names=[*names, ids])

    return df.select(*names, text).mapInArrow(run, schema)


def roundtrip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, n_bytes, exact): whether decoding the encoding gives the text again. NULL counts as empty."""
    schema = T.StructType([f for f in df.schema.fields if f.name == key] + [T.StructField("n_tokens", T.IntegerType()), T.StructField("n_bytes", T.LongType()), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            rows: list[tuple[int, int, bool]] = []
            for value in batch.column(text):
                value = value.as_py() or ""
                ids = coder.encode(value)
                rows.append((len(ids), len(value.encode("utf-8")), coder.decode(ids) == value))
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.bool_())], names=[key, "n_tokens", "n_bytes", "exact"])

    return df.select(key, text).mapInArrow(run, schema)
