"""Tables of a document: captions scored against assets of their page and its neighbours, claimed in order, notes attached.

Scores are a join on the page, for those who want all pairs. The claims, each of which takes away from the next, are a
loop over one paper's captions, which search its assets instead of scoring pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.operators.blocks import x_overlap

# What a claim needs, by how much it must be ahead, and from where on it is certain.
LEAST, AHEAD, SURE = 0.4, 0.15, 0.6
# A caption at HIGH or above it may belong to the page before, an asset that reaches LOW to the page after.
HIGH, LOW = 160, 900
BOX = ("x1", "y1", "x2", "y2")


def scores(captions: DataFrame, assets: DataFrame) -> DataFrame:
    """Every caption with the assets of its page and of the pages beside it. Both: paper_id, page, id, x1, y1, x2, y2; captions also number, continued."""
    a = assets.select("paper_id", F.col("page").alias("a_page"), *[F.col(c).alias(f"a_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    near = captions.withColumn("a_page", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    p = near.join(a, ["paper_id", "a_page"])
    same, before = F.col("a_page") == F.col("page"), F.col("a_page") == F.col("page") - 1
    over = x_overlap(F.col("x1"), F.col("x2"), F.col("a_x1"), F.col("a_x2")) >= 0.5
    at = F.when(same & (F.col("a_y1") >= F.col("y2")), 0.25).when(before, F.when(F.col("y1") <= HIGH, 0.1).otherwise(0.0) + F.when(F.col("a_y2") >= LOW, 0.1).otherwise(0.0)).otherwise(0.0)
    raw = F.when(same, 0.35).when(before, 0.2).otherwise(0.0) + F.when(over, 0.25).otherwise(0.0) + at + F.when(F.col("continued") & same, 0.15).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), raw), 4)
    decision = F.when(F.col("continued") & (score >= SURE), "continuation").when(score >= SURE, "matched").otherwise("ambiguous")
    return p.select("paper_id", F.col("id").alias("caption_id"), "page", "y1", "number", F.col("a_id").alias("asset_id"), "a_page", score.alias("score"), decision.alias("decision"))


def inventory(captions: DataFrame, assets: DataFrame) -> DataFrame:
    """(paper_id, caption_id, asset_id, status): captions in reading order claim the best asset of their page, then of a page beside it.

    A claim needs LEAST and to be AHEAD of the second best that is still free; SURE makes it certain. A caption without
    a candidate is unmatched, one without a clear best is ambiguous. Ids are distinct within a paper. One task holds the
    boxes of one paper, never their pairs.
    """
    box = [F.col("page").cast("long").alias("page"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]]
    rows = captions.select("paper_id", *box, "continued", F.lit(True).alias("caption"))
    rows = rows.unionByName(assets.filter("paper_id is not null and id is not null").select("paper_id", *box, F.lit(False).alias("continued"), F.lit(False).alias("caption")))
    return rows.groupBy("paper_id").applyInArrow(_claims, "paper_id long, caption_id long, asset_id long, status string")


def _levels(continued: bool, high: bool, beside: bool) -> list[tuple[float, int, bool, bool | None]]:
    """The scores a caption can give, the best first: score, page of the asset less its own, overlap, below it (on its page) or low (on the page before).

    continued: the caption continues a table. high: it stands high on its page. The values are those of scores().
    """
    both = list(itertools.product((True, False), repeat=2))
    found = [(0.35 + 0.25 * over + 0.25 * below + 0.15 * continued, 0, over, below) for over, below in both]
    if beside:
        found += [(0.2 + 0.25 * over + 0.1 * high + 0.1 * low, -1, over, low) for over, low in both]
        found += [(0.25 * over, 1, over, None) for over in (True, False)]
    return sorted(((round(min(1.0, s), 4), *x) for s, *x in found), key=lambda x: -x[0])


class _Caption:
    """A caption's box; a null is None."""

    def __init__(self, row: dict) -> None:
        self.id, self.page, self.continued = row["id"], row["page"], bool(row["continued"])
        self.x1, self.y1, self.x2, self.y2 = box = [row[k] for k in BOX]
        self.odd = not all(v is not None and np.isfinite(v) for v in box)
        self.width = None if self.x1 is None or self.x2 is None else self.x2 - self.x1
        self.high = self.y1 is not None and self.y1 <= HIGH


class _Page:
    """The assets of a page in blocks of near ones; a search leaves out the blocks that have nothing for it.

    Comparisons are Spark's: a null is left out of a least or greatest value, NaN is above all numbers.
    """

    BLOCK = 128

    def __init__(self, box: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """box, null: x1, y1, x2, y2 of each asset, and which of them are null."""
        odd = (null | ~np.isfinite(box)).any(axis=1)
        order = np.lexsort((ids, box[:, 0], odd))
        strip = np.arange(len(order)) // (self.BLOCK * max(1, round((len(order) / self.BLOCK) ** 0.5)))
        order = order[np.lexsort((box[order, 1], strip, odd[order]))]
        box, null, odd, self.ids = box[order], null[order], odd[order, None], ids[order]
        self.x1, self.y1, self.x2, self.y2 = box.T
        self.no_x1, self.no_y1, self.no_x2, self.no_y2 = null.T
        with np.errstate(invalid="ignore"):
            self.width, self.no_width = self.x2 - self.x1, self.no_x1 | self.no_x2
        starts = np.arange(0, len(order), self.BLOCK)
        self.least, self.most = np.minimum.reduceat(np.where(odd, -np.inf, box), starts), np.maximum.reduceat(np.where(odd, np.inf, box), starts)
        self.free, self.left = np.ones(len(order), bool), np.diff([*starts, len(order)])

    def take(self, row: int) -> int:
        self.free[row] = False
        self.left[row // self.BLOCK] -= 1
        return int(self.ids[row])

    def find(self, c: _Caption, at: int, over: bool, flag: bool | None, n: int) -> list[int]:
        """Rows of free assets of a level, n at most, for a caption whose page is this one less at."""
        b = self.left > 0
        if over and not c.odd:
            b &= (self.least[:, 0] < c.x2) & (self.most[:, 2] > c.x1)
        y, no_y, k, bound = (self.y1, self.no_y1, 1, c.y2) if at == 0 else (self.y2, self.no_y2, 3, LOW)
        if flag is not None and (at or not c.odd):
            b &= self.most[:, k] >= bound if flag else self.least[:, k] < bound
        blocks, found, start, step = np.flatnonzero(b), [], 0, 1
        while start < len(blocks) and len(found) < n:
            r = (blocks[start : start + step, None] * self.BLOCK + np.arange(self.BLOCK)).ravel()
            r = r[r < len(self.free)]
            r = r[self.free[r]]
            r = r[self._over(c, r) == over]
            if flag is not None:
                reached = ~no_y[r] & ((y[r] >= bound) | np.isnan(y[r])) if bound is not None else np.zeros(len(r), bool)
                r = r[reached == flag]
            found += r[: n - len(found)].tolist()
            start, step = start + step, min(4 * step, 512)
        return found

    def _over(self, c: _Caption, r: np.ndarray) -> np.ndarray:
        """Whether blocks.x_overlap() is at least a half."""

        def pick(f: np.ufunc, v: float | None, a: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (a, null) if v is None else (np.where(null, v, f(v, a)), np.zeros(len(a), bool))

        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            width, no_width = pick(np.fmin, c.width, self.width[r], self.no_width[r])
            right, no_right = pick(np.fmin, c.x2, self.x2[r], self.no_x2[r])
            left, no_left = pick(np.maximum, c.x1, self.x1[r], self.no_x1[r])
            shared = np.where(no_right | no_left, 0.0, np.maximum(0.0, right - left))
            return ~no_width & ~(width <= 0) & ~(shared / width < 0.5)


def _claims(paper: pa.Table) -> pa.Table:
    """The claims in one paper.

    Scores have few values. A caption looks for free assets of its best value, then of the next, until it has two or the
    next is AHEAD behind the first; so it sees few assets, not all of its page.
    """
    at = paper["caption"]
    rest = paper.filter(pc.and_(pc.invert(at), pc.is_valid(paper["page"])))
    box, null = np.column_stack([rest[k].fill_null(0.0).to_numpy() for k in BOX]), np.column_stack([rest[k].is_null().to_numpy() for k in BOX])
    page, ids = rest["page"].to_numpy(), rest["id"].to_numpy()
    order = np.argsort(page, kind="stable")
    numbers, starts = np.unique(page[order], return_index=True)
    pages = {int(p): _Page(box[i], null[i], ids[i]) for p, i in zip(numbers, np.split(order, starts[1:]))}
    last = lambda v: (v is None or v != v, 0 if v is None or v != v else v)
    captions = sorted(map(_Caption, paper.filter(at).to_pylist()), key=lambda c: (last(c.page), last(c.y1), last(c.id)))
    levels = {k: _levels(*k) for k in itertools.product((False, True), repeat=3)}
    state: list[tuple[int | None, str]] = [(None, "pending")] * len(captions)
    for beside in (False, True):
        for k, c in enumerate(captions):
            if state[k][1] != "pending":
                continue
            found: list[tuple[float, _Page, int]] = []
            for score, away, over, flag in levels[c.continued, c.high, beside]:
                if len(found) > 1 or (found[0][0] - score >= AHEAD - 1e-9 if found else score < LEAST):
                    break
                if c.page is not None and (p := pages.get(c.page + away)):
                    found += [(score, p, row) for row in p.find(c, away, over, flag, 2 - len(found))]
            if len(found) == 1:
                score, p, row = found[0]
                state[k] = (p.take(row), "matched" if score >= SURE else "matched_low_confidence")
            elif beside:
                state[k] = (None, "ambiguous" if found else "unmatched")
    one = paper["paper_id"][0].as_py()
    columns = {"paper_id": [one] * len(captions), "caption_id": [c.id for c in captions], "asset_id": [a for a, _ in state]}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"status": pa.array([s for _, s in state], pa.string())})


def notes(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """The note of each matched table: the nearest block within 60 units below its asset that overlaps it and reads like one.

    tables: paper_id, page, asset_id, x1, x2, y2. blocks: paper_id, page, id, x1, y1, x2, text.
    """
    t = tables.select("paper_id", "page", "asset_id", F.col("x1").alias("t_x1"), F.col("x2").alias("t_x2"), F.col("y2").alias("t_y2"))
    note = F.lower(F.trim("text")).rlike(r"^(?:notes?\b|abbreviations?\b|\*|†|‡|[a-d]\)|data are\b|values are\b)")
    gap = F.col("y1") - F.col("t_y2")
    near = blocks.filter(note).join(t, ["paper_id", "page"]).filter((gap >= 0) & (gap <= 60) & (x_overlap(F.col("x1"), F.col("x2"), F.col("t_x1"), F.col("t_x2")) >= 0.5))
    return near.groupBy("paper_id", "asset_id").agg(F.min_by("id", F.struct(gap, F.col("id"))).alias("note_id"))


def accounting(found: DataFrame) -> DataFrame:
    """Per paper: captions, matched ones, and those left over."""
    matched = F.col("status").isin("matched", "matched_low_confidence")
    return found.groupBy("paper_id").agg(F.count("*").alias("captions"), F.count_if(matched).alias("matched"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status") == "unmatched").alias("unmatched"))
