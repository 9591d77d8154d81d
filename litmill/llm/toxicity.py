"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning takes at most `per_class` labelled documents of each class (those with the smallest hash of their
id). Every word of theirs is in the index, with its document frequency over all documents. Examples are
TF-IDF vectors of unit length in blocks of BLOCK. Words that at least one in COMMON examples has are columns
of a matrix, with the largest weight in each block; the others have lists of postings, whose products are
added up first. A text is compared with the block of the highest bound first, and with another only if
that block's bound reaches the K-th best cosine in the first, so the K neighbours are exact.

Words of a text that no example has change its length alone, hence neither neighbours nor votes. score()
counts them over the documents it scores, so that the cosines it returns are those of whole texts.

Neighbours vote with their cosine times the weight that undoes the sampling of their class. Whole texts are
alike by their topic first, so the vote is joined by the text's lean: the mean, over its words, of the
smoothed log odds of toxic examples with the word, weighed down smoothly, never to a cut, where counts are
within chance. A logistic curve fitted on leave-one-out votes and leans of the examples turns both into a
probability. A text without a
word of any example has no neighbour and gets the rate of toxic examples without words.

Defined cases: null or empty texts have no word; without labels of both classes every score is the smoothed
class rate; several labels of one document count as the largest; a null doc_id is never learned from;
repeated rows get equal scores; ties in cosine go to the earlier example; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Workspace, chunks, flat, held_out, letters_digits, lowered, pick, spaced, words

#: Labelled documents learned from, of each class.
PER_CLASS = 2000
#: Words that one in COMMON examples has are columns of a matrix.
COMMON = 16
K = 15
BLOCK = 64
#: Texts compared at once, and postings whose products are added up at once.
ROWS, POSTINGS = 256, 1 << 18
#: Words of examples that training works on at once; a longer example is a step of its own.
WORDS = 1 << 17
#: Documents with crc32(doc_id) mod FOLDS = 0 are held out.
FOLDS = 5
THRESHOLD = 0.5

SCORED = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:float,toxic:int>>"


@dataclass
class Vectors:
    """TF-IDF vectors of texts, of unit length over the words that examples have."""

    common: np.ndarray  # texts x common words
    row: np.ndarray  # of every other word that an example has
    word: np.ndarray
    weight: np.ndarray
    square: np.ndarray  # squared length before division
    lean: np.ndarray
    new: tuple[np.ndarray, np.ndarray, np.ndarray]  # row, hash and squared 1 + ln(count) of the words that no example has


@dataclass
class Index:
    vocab: np.ndarray  # word hashes, ascending
    idf: np.ndarray
    postings: np.ndarray  # examples x common words, in blocks of BLOCK rows
    peak: np.ndarray  # blocks x common words: the largest weight of each word in each block
    doc_id: np.ndarray
    label: np.ndarray
    weight: np.ndarray  # of a vote
    slope: tuple[float, float] = (1.0, 0.0)  # of the vote and of the lean
    shift: float = 0.0
    without: float = 0.0  # score of a text that has no word of an example
    size: int = 0  # documents counted
    column: np.ndarray | None = None  # of each word of the vocabulary, -1 where it isn't common
    begin: np.ndarray | None = None  # where each word's postings begin, and the total
    example: np.ndarray | None = None
    share: np.ndarray | None = None  # weight of a posting
    lean: np.ndarray | None = None  # of each word

    def vectors(self, h: np.ndarray, first: np.ndarray) -> Vectors:
        """Vectors of the rows whose words these are."""
        n, v, columns = len(first) - 1, len(self.vocab), self.postings.shape[1]
        owner = np.repeat(np.arange(n), np.diff(first))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
        tf = 1 + np.log(np.diff(np.append(head, len(h))))
        h, owner = h[head], owner[head]
        at = np.minimum(np.searchsorted(self.vocab, h), v - 1) if v else np.zeros(len(h), np.int64)
        known = self.vocab[at] == h if v else np.zeros(len(h), bool)
        rest = ~known if v else known  # without examples there is no cosine to give
        new = owner[rest], h[rest], tf[rest] ** 2
        row, word = owner[known], at[known]
        x = tf[known] * self.idf[word]
        square = np.bincount(row, weights=x * x, minlength=n)
        x = x / np.sqrt(square[row])
        lean = np.bincount(row, weights=self.lean[word] if v else None, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
        column = self.column[word] if v else word
        dense = column >= 0
        common = np.zeros((n, columns), np.float32)
        common[row[dense], column[dense]] = x[dense]
        return Vectors(common, row[~dense], word[~dense], x[~dense], square, lean, new)

    def products(self, x: Vectors) -> np.ndarray:
        """Texts x examples: the part of the cosines that is due to words that aren't common."""
        n, m = len(x.common), len(self.label)
        length = self.begin[x.word + 1] - self.begin[x.word]
        first = np.searchsorted(x.row, np.arange(n + 1))  # words are in the order of their texts
        total = np.concatenate([[0], np.cumsum(length)])[first]
        out, i = np.zeros((n, m), np.float32), 0
        while i < n:  # as many texts as have about POSTINGS postings in all
            j = max(i + 1, int(np.searchsorted(total, total[i] + POSTINGS, "right")) - 1)
            of = slice(first[i], first[j])
            size = length[of]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(self.begin[x.word[of]], size) + inner
            cell = np.repeat((x.row[of] - i) * m, size) + self.example[at]
            out[i:j] = np.bincount(cell, weights=np.repeat(x.weight[of], size) * self.share[at], minlength=(j - i) * m).reshape(j - i, m)
            i = j
        return out

    def nearest(self, x: np.ndarray, k: int = K, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of each row and their cosines; -1 and 0 where there are fewer with a positive cosine.

        more: what is added to the products of common words, texts x examples.
        """
        n, blocks = len(x), len(self.peak)
        best, of = np.zeros((n, k), np.float32), np.full((n, k), -1)
        some = np.flatnonzero(x.any(axis=1) if more is None else x.any(axis=1) | more.any(axis=1))
        if not len(some) or not blocks:
            return of, best
        x, more = x[some], more[some] if more is not None else None
        bound = x @ self.peak.T
        if more is not None:
            bound += np.maximum.reduceat(more, np.arange(0, more.shape[1], BLOCK), axis=1)
        bound *= 1 + 1e-5  # a rounding slack keeps the bound a bound
        m = self.postings.shape[0]
        cosine = np.zeros((len(some), m), np.float32)

        def compare(rows: np.ndarray, b: int) -> None:
            cut = slice(b * BLOCK, min((b + 1) * BLOCK, m))
            got = x[rows] @ self.postings[cut].T
            cosine[rows, cut] = got if more is None else got + more[rows, cut]

        first = bound.argmax(axis=1)
        for b in np.unique(first):
            compare(np.flatnonzero(first == b), b)
        enough = np.partition(cosine, m - k, axis=1)[:, m - k] if m > k else np.zeros(len(some), np.float32)
        for b in range(blocks):
            rows = np.flatnonzero((first != b) & (bound[:, b] >= np.maximum(enough, 1e-12)))
            if len(rows):
                compare(rows, b)
        least = np.maximum(np.partition(cosine, m - k, axis=1)[:, m - k], 1e-30) if m > k else np.full(len(some), 1e-30, np.float32)
        row, example = np.nonzero(cosine >= least[:, None])
        value = cosine[row, example]
        order = np.lexsort((example, -value, row))
        row, example, value = row[order], example[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row]
        top = place < k
        best[some[row[top]], place[top]], of[some[row[top]], place[top]] = value[top], example[top]
        return of, best

    def neighbours(self, h: np.ndarray, first: np.ndarray, k: int = K) -> Iterator[tuple[Vectors, np.ndarray, np.ndarray]]:
        """Vectors, nearest examples and cosines of the rows whose words these are, ROWS at a time."""
        for i in range(0, len(first) - 1, ROWS):
            cut = first[i : i + ROWS + 1]
            x = self.vectors(h[cut[0] : cut[-1]], cut - cut[0])
            yield x, *self.nearest(x.common, k, self.products(x) if len(self.label) else None)

    def votes(self, of: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        w = np.where(of >= 0, cosine * self.weight[of], 0) if len(self.weight) else np.zeros(of.shape)
        yes = (w * (self.label[of] == 1)).sum(axis=1) if len(self.label) else np.zeros(len(of))
        vote = yes / np.maximum(w.sum(axis=1), 1e-30)
        return np.log((vote + 1e-3) / (1 - vote + 1e-3))

    def scores(self, of: np.ndarray, cosine: np.ndarray, lean: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(self.slope[0] * self.votes(of, cosine) + self.slope[1] * lean + self.shift)))
        return np.where((of >= 0).any(axis=1), p, self.without)


def _lean(d1: np.ndarray, d0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Of words that d1 of n1 toxic and d0 of n0 other examples have."""
    d, r = d1 + d0, n1 / (n1 + n0)
    p = (d1 + r) / (d + 1)
    z4 = ((d1 - d * r) ** 2 / (d * r * (1 - r) + 0.25)) ** 2
    return np.log(p / (1 - p) * (1 - r) / r) * z4 / (z4 + 81)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a ridge logistic curve by Newton's method; x has a column for each slope."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge, beta = np.append(np.full(x.shape[1], 0.1), 1e-3), np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ beta))
        g = a.T @ (w * (p - y)) + ridge * beta * np.append(np.ones(x.shape[1]), 0)
        beta -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(ridge), g).clip(-2, 2)
    return np.maximum(beta[:-1], 0), float(beta[-1])


def _word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, toxic and the hashes of the distinct words of each text."""
    low = lowered(letters_digits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(2))
            hashes, counts = [], []
            for i, j in chunks(off):
                h, first = words(*spaced(raw, off, i, j), low)
                for a, b in zip(first[:-1], first[1:]):
                    u, c = np.unique(h[a:b], return_counts=True)
                    hashes.append(u.tobytes())
                    counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "toxic", "h", "c"])

    return docs.mapInArrow(run, "doc_id long, toxic int, h binary, c binary")


def _frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and how many documents there are."""
    low = lowered(letters_digits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocab) + 1, np.int64), 0
        for batch in batches:
            raw, off = flat(batch.column(0))
            n += batch.num_rows
            for i, j in chunks(off):
                h, first = words(*spaced(raw, off, i, j), low)
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                known = np.flatnonzero(vocab[at] == h)
                pair = np.unique((np.searchsorted(first, known, "right") - 1) * len(vocab) + at[known])
                df[:-1] += np.bincount(pair % len(vocab), minlength=len(vocab))
        df[-1] = n
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(df[met])], names=["term", "df"])

    rows = pick(docs, "text").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each word of the examples
    df = np.zeros(len(vocab) + 1, np.int64)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return df[:-1], int(df[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, corpus: DataFrame | None = None) -> Index:
    """An index of labelled documents that aren't held out. corpus: counted for the document frequencies, docs by default."""
    known = pick(labels, "doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").filter(~held_out("doc_id", FOLDS, 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    nearest_hash = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = nearest_hash[0].unionByName(nearest_hash[1])  # at most 2 * per_class rows
    rows = _word_counts(pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")).toArrow()
    ids, y = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(np.int64)
    hs, cs = ([np.frombuffer(x.as_buffer(), t) for x in rows[c]] for c, t in (("h", np.uint64), ("c", np.int32)))  # views of the table
    _, at, times = np.unique(ids, return_inverse=True, return_counts=True)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], hs[i].tobytes() if times[at[i]] > 1 else b""))
    ids, y, hs, cs = ids[order], y[order], [hs[i] for i in order], [cs[i] for i in order]
    n = np.bincount(y, minlength=2) if len(y) else np.zeros(2, np.int64)
    total = np.array([counts.get(c, 0) for c in (0, 1)])
    rate = (total[1] + 0.5) / (total.sum() + 1)
    nothing = Index(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.int64), y[:0], np.zeros(0), without=float(rate))
    if n.min() == 0:
        return nothing
    vocab = np.zeros(0, np.uint64)
    for i, j in _steps(hs):
        vocab = np.union1d(vocab, np.concatenate(hs[i:j]))
    if not len(vocab):
        return nothing
    df, size = _frequencies(corpus if corpus is not None else docs, vocab)
    index = nothing
    index.vocab, index.idf, index.size = vocab, np.log((1 + size) / (1 + df)) + 1, size
    weight = np.array([total[0] / n[0], total[1] / n[1]])
    bare = np.array([not len(h) for h in hs])
    index.without = float((weight[y[bare]] * y[bare]).sum() + 0.5 * rate) / float(weight[y[bare]].sum() + 0.5)
    keep = np.flatnonzero(~bare)  # a text without words has no cosine with any other
    heavy = [np.searchsorted(vocab, hs[i])[np.argmax((1 + np.log(cs[i])) * index.idf[np.searchsorted(vocab, hs[i])])] for i in keep]
    keep = keep[np.lexsort((keep, heavy))]  # alike examples share blocks, which keeps the bounds tight
    index.label, index.weight, index.doc_id = y[keep], weight[y[keep]], ids[keep]
    _fill(index, [hs[i] for i in keep], [cs[i] for i in keep], n)
    return index


def _steps(parts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of at most ROWS examples, with about WORDS words each; parts: an array of its words for each example."""
    return chunks(np.cumsum([0, *map(len, parts)]), WORDS, ROWS)


def _parts(index: Index, hs: list[np.ndarray], cs: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a step's examples: their range, and the example, word and weight of each posting.

    Nothing is held for all postings at once but the index itself, as the driver's memory is what training takes most of.
    """
    for i, j in _steps(hs):
        some = slice(i, j)
        example = np.repeat(np.arange(j - i), [len(h) for h in hs[some]])
        word = np.searchsorted(index.vocab, np.concatenate(hs[some]))
        x = (1 + np.log(np.concatenate(cs[some]))) * index.idf[word]
        yield some, i + example, word, x / np.sqrt(np.bincount(example, weights=x * x))[example]


def _fill(index: Index, hs: list[np.ndarray], cs: list[np.ndarray], n: np.ndarray) -> None:
    """Postings of the examples with these words, and the curve fitted on them; n: examples of each class."""
    size, m = len(index.vocab), len(hs)
    d, d1 = np.zeros(size, np.int64), np.zeros(size)
    for _, example, word, _ in _parts(index, hs, cs):
        d += np.bincount(word, minlength=size)
        d1 += np.bincount(word, weights=index.label[example], minlength=size)
    d0 = d - d1
    index.lean = _lean(d1, d0, int(n[1]), int(n[0]))
    common = np.flatnonzero(d * COMMON >= m)
    index.column = np.full(size, -1, np.int32)
    index.column[common] = np.arange(len(common))
    index.postings = np.zeros((m, len(common)), np.float32)
    index.begin = np.concatenate([[0], np.cumsum(np.where(index.column < 0, d, 0))])
    index.example, index.share = np.zeros(index.begin[-1], np.int32), np.zeros(index.begin[-1], np.float32)
    free, lean = index.begin[:-1].copy(), np.zeros(m)  # free: where the next posting of each word goes
    for some, example, word, x in _parts(index, hs, cs):
        # leave-one-out leans
        own = index.label[example]
        others = np.where(d[word] > 1, _lean(d1[word] - own, d0[word] - (1 - own), n[1] - own, n[0] - (1 - own)), 0) if n.min() > 1 else np.zeros(len(word))
        lean[some] = np.bincount(example - some.start, weights=others) / np.bincount(example - some.start)
        dense = index.column[word] >= 0
        index.postings[example[dense], index.column[word[dense]]] = x[dense]
        rest = np.flatnonzero(~dense)
        rest = rest[np.argsort(word[rest], kind="stable")]
        place = free[word[rest]] + np.arange(len(rest)) - np.searchsorted(word[rest], word[rest])
        index.example[place], index.share[place] = example[rest], x[rest]
        free += np.bincount(word[rest], minlength=size)
    index.peak = np.stack([index.postings[i : i + BLOCK].max(axis=0) for i in range(0, m, BLOCK)])
    if m and n.min() > 1:  # leave-one-out votes
        found = []
        for i, j in _steps(hs):
            first = np.concatenate([[0], np.cumsum([c.sum() for c in cs[i:j]])])
            found += [near for _, *near in index.neighbours(np.repeat(np.concatenate(hs[i:j]), np.concatenate(cs[i:j])), first, K + 1)]
        of, cosine = (np.concatenate(part) for part in zip(*found))
        self_ = of == np.arange(m)[:, None]
        last = ~self_.any(axis=1)
        self_[last, -1] = True
        of, cosine = of[~self_].reshape(-1, K), cosine[~self_].reshape(-1, K)
        some = (of >= 0).any(axis=1)
        if some.any() and len(set(index.label[some])) == 2:
            spread = max(float(lean[some].std()), 1e-9)
            slope, index.shift = _logistic(np.column_stack([index.votes(of, cosine), lean / spread])[some], index.label[some], index.weight[some])
            index.slope = float(slope[0]), float(slope[1] / spread)


def _scored(column: pa.Array, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Vectors]]:
    low = lowered(letters_digits())
    raw, off = flat(column)
    for i, j in chunks(off):
        for x, of, cosine in index.neighbours(*words(*spaced(raw, off, i, j), low)):
            yield index.scores(of, cosine, x.lean), of, cosine, x


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, held_out, score, predicted and the three nearest examples of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # the words of at most 2 * PER_CLASS examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, at = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            scores, counts, examples, cosines, square, sizes, new, weight = [], [], [], [], [], [], [], []
            for s, of, cosine, x in _scored(batch.column(2), ix):
                scores.append(s)
                near = of[:, :3] >= 0
                counts.append(near.sum(axis=1))
                examples.append(of[:, :3][near])
                cosines.append(cosine[:, :3][near])
                square.append(x.square)
                row, h, w = x.new
                sizes.append(np.bincount(row, minlength=len(s)))
                new.append(h.view(np.int64))
                weight.append(w)
            joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
            s, n = joined(scores), batch.num_rows
            off = pa.array(np.concatenate([[0], np.cumsum(joined(sizes))]).astype(np.int32))
            e = joined(examples).astype(np.int64)
            near = pa.StructArray.from_arrays([pa.array(ix.doc_id[e], pa.int64()), pa.array(joined(cosines).astype(np.float32)), pa.array(ix.label[e].astype(np.int32))], names=["doc_id", "cosine", "toxic"])
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(joined(counts))]).astype(np.int32)), near)
            pairs = pa.StructArray.from_arrays([pa.array(joined(new).astype(np.int64)), pa.array(joined(weight).astype(np.float64))], names=["h", "w"])
            columns = [pa.array(np.arange(at, at + n)), batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), evidence, pa.array(joined(square).astype(np.float64)), pa.ListArray.from_arrays(off, pairs)]
            at += n
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "score", "predicted", "evidence", "square", "new"])

    scored = pick(docs, "doc_id", "text").select("doc_id", held_out("doc_id", FOLDS, 0).alias("held_out"), "text")
    scored = scored.mapInArrow(run, f"row long, {SCORED}, square double, new array<struct<h:long,w:double>>")
    scored = Workspace(docs.sparkSession, "toxicity").keep(scored, "scored")
    # the rest of each text's squared length: words that no example has, counted over the documents
    new = scored.select("row", F.explode("new").alias("x")).select("row", "x.h", "x.w")
    idf = F.log((1 + index.size) / (1 + F.col("df"))) + 1
    rest = new.join(new.groupBy("h").agg(F.count("*").alias("df")), "h").groupBy("row").agg(F.sum(F.col("w") * idf * idf).alias("rest"))
    whole = F.sqrt(F.col("square") / F.greatest(F.col("square") + F.coalesce("rest", F.lit(0.0)), F.lit(1e-30)))
    evidence = F.transform("evidence", lambda e: F.struct(e.doc_id.alias("doc_id"), (e.cosine * whole).cast("float").alias("cosine"), e.toxic.alias("toxic")))
    return scored.join(rest, "row", "left").select("doc_id", "held_out", "score", "predicted", evidence.alias("evidence"))


def remove(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [x[0] for x in _scored(batch.column(text), shared.value)]
            yield batch.filter(pa.array((np.concatenate(s) if s else np.zeros(0)) < threshold))

    return docs.mapInArrow(run, docs.schema)
