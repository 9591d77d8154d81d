"""Benchmark decontamination with suffix arrays over the training words.

Every shard (some megabytes of documents) gets the suffix array of its words, sorted to the ends of its documents by
prefix doubling. Every benchmark suffix is searched in it: its interval is narrowed word by word, by binary search,
until it is empty or the window is full. A window is `window` consecutive words of an item; an item of fewer words (but
not none) is one window. Words inside any occurrence of a window are hit. Occurrences are never listed: covered
places are the sum of interval ends over the suffix array, then over the text, and an item's documents are the ranks
of its interval whose preceding rank of the same document lies before the interval. Longest verbatim matches are found
from where a suffix would be inserted in its interval: nearest neighbours share the most words, which hashes of word
ranges count by halving.

Shards are read once, without a shuffle. The benchmark goes to all tasks in blocks of at most about BLOCK_WORDS words,
of which driver and tasks hold one at a time; each block is a pass of its own, and what the passes after the first
find (rows of contaminated documents alone) is joined by doc_id and a hash of the text.

Defined cases: null and empty texts have no words and are never contaminated; items without words have no
window; items of equal item_id count once, equal texts under different ids each; repeated rows are judged alike and
all returned; a null item_id counts under the text 'null'; a very long text is a shard of its own, in time n log(n)^2;
empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill.llm.common import Workspace, _Powers, chunks, flat, letters_digits, lowered, pick, spaced, words

WINDOW = 13
#: A document is contaminated when hit words make up at least one in SHARE of its words.
SHARE = 20
BLOCK_WORDS = 2_000_000
#: Ranks of an interval beyond which it is gone through on its own.
WIDE = 4096

INTERVAL = "array<struct<a:int,b:int>>"
MATCH = "array<struct<item:string,at:int,start:int,length:int>>"
FOUND = f"n_words long, hits {INTERVAL}, matches {MATCH}"


@dataclass
class Benchmark:
    """A block of items: word hashes in a row, and for each word the suffix that begins there."""

    ids: list[str]
    word: np.ndarray
    item: np.ndarray  # of each word
    at: np.ndarray  # its place in the item
    left: np.ndarray  # words to the end of its item
    size: np.ndarray  # words of the window that begins here; 0 where none does

    def __post_init__(self) -> None:
        self.distinct, self.number = np.unique(self.word, return_inverse=True)


def _block(ids: list[str], parts: list[np.ndarray], window: int) -> Benchmark:
    sizes = np.array([len(p) for p in parts], np.int64)
    item = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[item] - at
    need = np.minimum(sizes, window)[item]
    return Benchmark(list(ids), np.concatenate([*parts, np.zeros(0, np.uint64)]), item, at, left, np.where(left >= need, need, 0))


def read_items(bench: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS) -> Iterator[Benchmark]:
    """Blocks of items, read one partition at a time."""
    low = lowered(letters_digits())
    ids: list[str] = []
    parts: list[np.ndarray] = []
    total = 0
    for row in pick(bench, "item_id", "text").toLocalIterator():
        raw, off = flat(pa.array([row.text], pa.string()))
        h, _ = words(*spaced(raw, off, 0, 1), low)
        ids.append("null" if row.item_id is None else str(row.item_id))
        parts.append(h)
        total += len(h)
        if total >= block:
            yield _block(ids, parts, window)
            ids, parts, total = [], [], 0
    if ids:
        yield _block(ids, parts, window)


def suffix_array(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in the order of the words that follow, up to the end of each one's document (left words away).

    Prefix doubling: places are sorted by their first word, and those that tie by the ranks of what follows 1, 2, 4,
    ... words on, until none ties before its document ends.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], word[order][1:] != word[order][:-1]])) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    slots, k = np.arange(n), 1
    while len(slots):
        place = order[slots]
        group = rank[place]  # slots hold whole groups, in order
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(head, len(slots)))
        open_ = np.repeat((size > 1) & (np.maximum.reduceat(left[place], head) > k), size)
        slots, place, group = slots[open_], place[open_], group[open_]
        if not len(slots):
            break
        after = np.where(left[place] > k, rank[np.minimum(place + k, n - 1)] + 1, 0)
        by = np.argsort(group * (n + 2) + after, kind="stable")
        place, group, after = place[by], group[by], after[by]
        order[slots] = place
        head = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])]))
        rank[place] = np.repeat(slots[head], np.diff(np.append(head, len(slots))))
        k *= 2
    return order


@dataclass
class Shard:
    """Words of some documents and their suffix array."""

    word: np.ndarray
    first: np.ndarray  # first word of each document, and the total

    def __post_init__(self) -> None:
        size = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.left = self.first[1:][self.doc] - np.arange(len(self.word))
        self.known, self.number = np.unique(self.word, return_inverse=True)
        self.order = suffix_array(self.number, self.left)

    def value(self, rank: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The word so deep in the suffixes of these ranks; -1 where the document has ended."""
        place = self.order[rank]
        return np.where(self.left[place] > depth, self.number[np.minimum(place + depth, len(self.word) - 1)], -1)

    def bound(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
        """First rank in [lo, hi) whose word at that depth is at least this one."""
        lo, hi = lo.copy(), hi.copy()
        while len(some := np.flatnonzero(lo < hi)):
            mid = (lo[some] + hi[some]) // 2
            less = self.value(mid, depth) < word[some]
            lo[some] = np.where(less, mid + 1, lo[some])
            hi[some] = np.where(less, hi[some], mid)
        return lo

    def search(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, lo, hi) of the benchmark suffixes whose window occurs, with its interval of ranks."""
        nothing = (np.zeros(0, np.int64),) * 3
        if not len(self.word) or not len(bench.word):
            return nothing
        at = np.minimum(np.searchsorted(self.known, bench.distinct), len(self.known) - 1)
        number = np.where(self.known[at] == bench.distinct, at, -1)[bench.number]
        start = np.concatenate([[0], np.cumsum(np.bincount(self.number, minlength=len(self.known)))])
        suffix = np.flatnonzero(number >= 0)
        lo, hi = start[number[suffix]], start[number[suffix] + 1]
        out, depth = [], 1
        while len(suffix):
            full = bench.size[suffix] == depth
            out.append((suffix[full], lo[full], hi[full]))
            on = ~full & (bench.left[suffix] > depth)
            suffix, lo, hi = suffix[on], lo[on], hi[on]
            word = number[np.minimum(suffix + depth, len(number) - 1)]
            here = word >= 0
            suffix, lo, hi, word = suffix[here], lo[here], hi[here], word[here]
            lo, hi = self.bound(lo, hi, word, depth), self.bound(lo, hi, word + 1, depth)
            some = lo < hi
            suffix, lo, hi = suffix[some], lo[some], hi[some]
            depth += 1
        return tuple(np.concatenate(x) for x in zip(*out)) if out else nothing

    def covered(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each word lies inside an occurrence of a window of these intervals and sizes."""
        n = len(self.word)
        edge = np.zeros(n + 1, np.int64)
        for m in np.unique(size):
            ranks = np.zeros(n + 1, np.int64)
            np.add.at(ranks, lo[size == m], 1)
            np.add.at(ranks, hi[size == m], -1)
            place = self.order[np.cumsum(ranks[:-1]) > 0]
            edge[place] += 1
            np.add.at(edge, place + m, -1)
        return np.cumsum(edge[:-1]) > 0

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The ranks before and after each rank at which the same document has a suffix; -1 and n where there is none."""
        n = len(self.word)
        doc = self.doc[self.order]
        by = np.argsort(doc, kind="stable")
        same = doc[by][1:] == doc[by][:-1]
        before, after = np.full(n, -1), np.full(n, n)
        before[by[1:][same]] = by[:-1][same]
        after[by[:-1][same]] = by[1:][same]
        return before, after

    def shared(self, place: np.ndarray, bench: Benchmark, suffix: np.ndarray) -> np.ndarray:
        """Words that the texts from these places on share with benchmark suffixes, by halving over hashes of ranges."""
        up, down = _Powers.upto(max(len(self.word), len(bench.word)) + 1)
        with np.errstate(over="ignore"):
            ours = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.word * up[: len(self.word)])])
            theirs = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bench.word * up[: len(bench.word)])])
            lo, hi = np.zeros(len(place), np.int64), np.minimum(self.left[place], bench.left[suffix])
            while (lo < hi).any():
                mid = (lo + hi + 1) // 2
                equal = (ours[place + mid] - ours[place]) * down[place] == (theirs[suffix + mid] - theirs[suffix]) * down[suffix]
                lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
        return lo

    def insertion(self, bench: Benchmark, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rank in its interval at which each benchmark suffix would stand."""
        lo, hi = lo.copy(), hi.copy()
        while len(some := np.flatnonzero(lo < hi)):
            mid = (lo[some] + hi[some]) // 2
            place, s = self.order[mid], suffix[some]
            n = self.shared(place, bench, s)
            ours = np.where(self.left[place] > n, self.known[self.number[np.minimum(place + n, len(self.word) - 1)]], np.uint64(0))
            theirs = np.where(bench.left[s] > n, bench.word[np.minimum(s + n, len(bench.word) - 1)], np.uint64(0))
            # at an equal end the text's suffix counts as the lesser one
            less = (self.left[place] <= n) | (bench.left[s] > n) & (ours < theirs)
            lo[some] = np.where(less, mid + 1, lo[some])
            hi[some] = np.where(less, hi[some], mid)
        return lo

    def matches(self, bench: Benchmark, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, suffix, words) of each benchmark suffix's longest match in each document of its interval."""
        if not len(suffix):
            return (np.zeros(0, np.int64),) * 3
        before, after = self.neighbours()
        at = self.insertion(bench, suffix, lo, hi)
        ranks, of = [], []
        wide = hi - lo > WIDE
        length = np.where(wide, 0, hi - lo)
        r = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
        s = np.repeat(np.arange(len(suffix)), length)
        # nearest to the insertion on either side: the last of its document before it, or the first from it on
        near = np.where(r < at[s], after[r] >= at[s], before[r] < at[s])
        ranks.append(r[near])
        of.append(s[near])
        for k in np.flatnonzero(wide):
            r = np.concatenate([lo[k] + np.flatnonzero(after[lo[k] : at[k]] >= at[k]), at[k] + np.flatnonzero(before[at[k] : hi[k]] < at[k])])
            ranks.append(r)
            of.append(np.full(len(r), k))
        r, s = np.concatenate(ranks), np.concatenate(of)
        place, s = self.order[r], suffix[s]
        return place, s, self.shared(place, bench, s)


def _runs(mask: np.ndarray, first: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])] if len(edge) else []


def examined(column: pa.Array, bench: Benchmark) -> Iterator[tuple[int, list[dict], list[dict]]]:
    """Of each text: its number of words, its hit words as intervals, and its longest match with each item.

    A match is (item_id, its place in the item, its place in the text, its length), in words. Of equally long ones in
    one text it is one of them.
    """
    low = lowered(letters_digits())
    raw, off = flat(column)
    for i, j in chunks(off):
        h, first = words(*spaced(raw, off, i, j), low)
        shard = Shard(h, first)
        suffix, lo, hi = shard.search(bench)
        if not len(suffix):
            yield from ((int(n), [], []) for n in np.diff(first))
            continue
        hit = shard.covered(lo, hi, bench.size[suffix])
        place, suffix, length = shard.matches(bench, suffix, lo, hi)
        doc = shard.doc[place]
        best: list[dict] = [{} for _ in range(j - i)]
        for k in np.lexsort((bench.at[suffix], place, -length)).tolist():
            best[doc[k]].setdefault(bench.ids[bench.item[suffix[k]]], (int(bench.at[suffix[k]]), int(place[k] - first[doc[k]]), int(length[k])))
        for d in range(j - i):
            found = [{"item": x, "at": m[0], "start": m[1], "length": m[2]} for x, m in sorted(best[d].items())]
            yield int(first[d + 1] - first[d]), _runs(hit[first[d] : first[d + 1]], int(first[d])) if found else [], found


def _searched(texts: DataFrame, bench: Benchmark) -> DataFrame:
    """doc_id, text_hash and what was found in each text."""
    shared = texts.sparkSession.sparkContext.broadcast(bench)  # about BLOCK_WORDS words
    kinds = [f.dataType for f in T._parse_datatype_string(FOUND).fields]
    schema = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("matches", pa.list_(pa.struct([("item", pa.string()), ("at", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*examined(batch.column(2), shared.value))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, f.type) for c, f in zip(found, schema)]], names=["doc_id", "text_hash", *schema.names])

    fields = [texts.schema[c] for c in ("doc_id", "text_hash")] + [T.StructField(n, k) for n, k in zip(schema.names, kinds)]
    return texts.select("doc_id", "text_hash", "text").mapInArrow(run, T.StructType(fields))


def _covered(hits: Column) -> Column:
    """Words in a union of intervals, which are sorted by their starts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(hits, zero, lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, s.to))).alias("n"), F.greatest(s.to, x.b).alias("to")), lambda s: s.n).cast("long")


def _all_found(docs: DataFrame, bench: DataFrame, window: int, block: int) -> DataFrame:
    """doc_id, text_hash, n_words, hits and matches of every row, over all blocks."""
    texts = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    blocks = read_items(bench, window, block)
    one, two = next(blocks, None) or _block([], [], window), next(blocks, None)
    found = _searched(texts, one)
    if two is None:
        return found
    work = Workspace(docs.sparkSession, "decontamination")
    found, k, more = work.keep(found, "0"), 0, None
    while two is not None:
        k += 1
        part = work.keep(_searched(texts, two).filter("size(matches) > 0").drop("n_words"), str(k))
        more = part if more is None else more.unionByName(part)
        two = next(blocks, None)
    # rows equal in doc_id and text found the same in each block
    found = found.withColumn("first", F.lit(True))
    merged = more.distinct().groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.flatten(F.collect_list("hits")).alias("h"), F.flatten(F.collect_list("matches")).alias("m"))
    joined = found.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t")), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    matches = F.concat("matches", none(F.col("m"), MATCH))
    longest = F.array_sort(F.transform(matches, lambda x: F.struct(x.item.alias("item"), (-x.length).alias("less"), x.start.alias("start"), x["at"].alias("at"))))
    return joined.select("doc_id", "text_hash", "n_words", F.array_sort(F.concat("hits", none(F.col("h"), INTERVAL))).alias("hits"), _first_of_item(longest).alias("matches"))


def _first_of_item(sorted_: Column) -> Column:
    """Of matches sorted by item, then longest first, the first of each item."""
    kept = F.filter(F.transform(sorted_, lambda x, i: F.struct(x.alias("x"), F.get(sorted_, i - 1).item.eqNullSafe(x.item).alias("again"))), lambda y: ~y.again)
    return F.transform(kept, lambda y: F.struct(y.x.item.alias("item"), y.x["at"].alias("at"), y.x.start.alias("start"), (-y.x.less).alias("length")))


def find(docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: int = SHARE, block: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match and matches.

    matches has the longest match with each item that occurs: item, place in the item, place in the text, length (words).
    """
    n_hit = _covered(F.col("hits"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda x: x.length)), F.lit(0))
    out = _all_found(docs, bench, window, block).select("doc_id", "n_words", n_hit.alias("n_hit"), longest.alias("longest_match"), F.transform("matches", lambda x: x.item).alias("items"), "matches")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "longest_match", "matches",
    )


def contaminated_mask(column: pa.Array, bench: Benchmark, share: int = SHARE) -> np.ndarray:
    """True for the contaminated texts of an Arrow column."""
    low, out = lowered(letters_digits()), [np.zeros(0, bool)]
    raw, off = flat(column)
    for i, j in chunks(off):
        shard = Shard(*words(*spaced(raw, off, i, j), low))
        suffix, lo, hi = shard.search(bench)
        hit = np.concatenate([[0], np.cumsum(shard.covered(lo, hi, bench.size[suffix]))])
        n_hit = hit[shard.first[1:]] - hit[shard.first[:-1]]
        out.append((n_hit > 0) & (n_hit * share >= np.diff(shard.first)))
    return np.concatenate(out)


def remove(docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: int = SHARE, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    blocks = read_items(bench, window, block)
    one, two = next(blocks, None), next(blocks, None)
    if one is None:
        return docs
    text = docs.columns.index("text")
    if two is None:
        shared = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~contaminated_mask(batch.column(text), shared.value, share)))

        return docs.mapInArrow(run, docs.schema)
    # hits of several blocks count together
    n_hit = _covered(F.col("hits"))
    gone = _all_found(docs, bench, window, block).filter((n_hit > 0) & (n_hit * share >= F.col("n_words"))).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text"))
    gone = Workspace(docs.sparkSession, "decontamination").keep(gone.distinct(), "gone")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    same = F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col(f"c{text}")) == F.col("_text"))
    return plain.join(gone, same, "left_anti").toDF(*docs.columns)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
