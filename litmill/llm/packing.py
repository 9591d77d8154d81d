"""Packing of tokenized documents into fixed windows by best-fit decreasing.

A document's ids are cut into full windows first; what is left over (shorter than a window) is packed,
longest first, into the open window with the least room that still takes it. A segment tree over the
remaining capacities 0..size finds that window in log2(size) steps.

Each task packs what it reads, in shards of SHARD remainders, so texts aren't shuffled and memory is bounded
by a shard. A shard's windows that are not FULL are opened again: the remainders in them, of all tasks, are dealt into
groups of SHARD and packed a second time, so that a table in many small files is packed as tightly as one in few.
Sequences are numbered from their partition's number, so they are unique without coordination.

Ids are those of the tokenizer file as the tokenizers library reads it, its added tokens in a text included. The text is
cut at added tokens and goes through a faster library that has the same ranks and split pattern; what that library can't
take (very long white space), or a file with added tokens that also take their surroundings, goes to the tokenizer itself.

Defined cases: a null or empty text is one piece holding the end id alone; repeated rows are separate
documents; a null doc_id stays null; a very long text is full windows and one remainder; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from litmill.llm.common import Workspace, pick

SIZE = 2048
END_ID = 1
#: Remainders packed together.
SHARD = 8192
#: Share of a window's tokens below which its remainders are packed once more.
FULL = 0.98

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# The tokenizer's split pattern and its byte alphabet are fixed values of the published vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in a row that the faster library isn't given.
RUN = 100_000
LONG = re.compile(rf"\s{{{RUN}}}")


class FreeRoom:
    """Open windows by remaining capacity; a segment tree over capacities counts them."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least need, as (room, window), removed."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.open[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, window


def best_fit(lengths: list[int], size: int = SIZE) -> tuple[list[tuple[int, int]], int]:
    """(window, offset) of each length, and the number of windows; longest first, ties in the order given."""
    room, placed, windows = FreeRoom(size), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[i])
        left, window = found or (size, windows)
        windows += found is None
        placed[i] = (window, size - left)
        if left > lengths[i]:
            room.add(left - lengths[i], window)
    return placed, windows


class Encoder:
    """Little-endian 32-bit ids of texts, as the tokenizer of that file gives them with add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = {t["content"]: np.asarray([t["id"]], "<u4").tobytes() for t in file["added_tokens"]}
        self.plain = not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte = _alphabet()
        ranks = {bytes(byte[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in self.added}
        self.ranked = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        special = self.cut is not None and self.cut.search(text) is not None
        if len(text) >= RUN and LONG.search(text) or special and not self.plain:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not special:
            return np.asarray(self.ranked(text), "<u4").tobytes()
        return b"".join(self.added[x] if k % 2 else np.asarray(self.ranked(x), "<u4").tobytes() for k, x in enumerate(self.cut.split(text)))


def _alphabet() -> dict[str, int]:
    """The vocabulary writes byte b as itself where that is a printing Latin-1 character, else as the next unused code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Pieces:
    """Columns of the result, and the sequences numbered so far in this task."""

    def __init__(self, size: int, last: bool) -> None:
        self.size, self.rows, self.rest = size, [], []
        self.least = 0 if last else FULL * size
        self.next = (int(last) << 62) + (TaskContext.get().partitionId() << 40)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, full = len(ids) // 4, 4 * self.size
        for at in range(0, len(ids) - full + 1, full):
            self.rows.append((doc_id, at // 4, self.size, zlib.crc32(ids[at : at + full]), n, self.next, 0))
            self.next += 1
        if left := n % self.size:
            self.rest.append((doc_id, n - left, left, zlib.crc32(ids[4 * (n - left) :]), n))

    def pack(self) -> None:
        """Place the remainders; those in windows that aren't full enough get no sequence."""
        placed, windows = best_fit([r[2] for r in self.rest], self.size)
        load = np.bincount([w for w, _ in placed], weights=[r[2] for r in self.rest], minlength=windows) if placed else np.zeros(0)
        number = np.where(load >= self.least, self.next + np.cumsum(load >= self.least) - 1, -1).tolist()
        self.rows += [(*r, number[w], offset) if number[w] >= 0 else (*r, None, None) for r, (w, offset) in zip(self.rest, placed)]
        self.next += int((load >= self.least).sum())
        self.rest = []

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(schema), schema=schema)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = Encoder(tokenizer), _Pieces(size, False)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.add(doc_id, encode(text.as_py() or "") + end)
                if len(out.rest) >= shard:
                    out.pack()
                if len(out.rows) >= 20_000:
                    yield out.batch(schema)
        out.pack()
        yield out.batch(schema)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pieces(size, True)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns[:5]]):
                out.rest.append(row)
                if len(out.rest) >= 2 * shard:
                    out.pack()
            yield out.batch(schema)
        out.pack()
        yield out.batch(schema)

    first = Workspace(docs.sparkSession, "packing").keep(pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA), "first")
    loose = first.filter("sequence_id is null")
    groups = -(-loose.count() // shard)
    done = first.filter("sequence_id is not null")
    return done.unionByName(loose.repartition(groups).mapInArrow(again, SCHEMA)) if groups else done
