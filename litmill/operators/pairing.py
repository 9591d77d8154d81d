"""Grouped assignment: asset clusters, exclusive claims of assets by legends. One page or paper at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Ledger:
    """Exclusive claims with a journal."""

    owner: dict = field(default_factory=dict)
    journal: list[tuple] = field(default_factory=list)

    def claim(self, legend: object, assets: list, why: str) -> bool:
        free = all(a not in self.owner for a in assets) and bool(assets)
        if free:
            self.owner.update(dict.fromkeys(assets, legend))
        self.journal.append((why, legend, tuple(assets), free))
        return free

    def free(self, assets: list) -> list:
        return [a for a in assets if a not in self.owner]


Pass = Callable[[pd.DataFrame, pd.DataFrame, Ledger], None]


def same_page(legends: pd.DataFrame, assets: pd.DataFrame, ledger: Ledger) -> None:
    """The best-scoring pairs of a page first: overlap in x, then the smallest vertical gap."""
    proposals = []
    for legend in legends.itertuples():
        for a in assets[assets.page == legend.page].itertuples():
            width = min(legend.x2 - legend.x1, a.x2 - a.x1)
            over = max(0.0, min(legend.x2, a.x2) - max(legend.x1, a.x1)) / width if width > 0 else 0.0
            gap = min(abs(legend.y1 - a.y2), abs(a.y1 - legend.y2))
            if over >= 0.4 and gap <= 300:
                proposals.append((-over, gap, legend.id, a.id))
    _settle(proposals, ledger, "same_page")


def next_page(legends: pd.DataFrame, assets: pd.DataFrame, ledger: Ledger) -> None:
    """Legends without an asset take the last free asset of the page before."""
    proposals = [(0.0, -a.y2, legend.id, a.id) for legend in legends.itertuples() for a in assets[assets.page == legend.page - 1].itertuples()]
    _settle(proposals, ledger, "next_page")


def in_sequence(legends: pd.DataFrame, assets: pd.DataFrame, ledger: Ledger) -> None:
    """What is left is paired in reading order on each page."""
    done = set(ledger.owner.values())
    for page, left in legends[~legends.id.isin(done)].sort_values(["page", "y1", "x1", "id"]).groupby("page"):
        free = [a for a in assets[assets.page == page].sort_values(["y1", "x1", "id"]).id if a not in ledger.owner]
        for legend, asset in zip(left.id, free):
            ledger.claim(legend, [asset], "in_sequence")


def _settle(proposals: list[tuple], ledger: Ledger, why: str) -> None:
    done = set(ledger.owner.values())
    for _, _, legend, asset in sorted(proposals):
        if legend not in done and ledger.claim(legend, [asset], why):
            done.add(legend)


PASSES: list[Pass] = [same_page, next_page, in_sequence]


def pair(blocks: DataFrame, passes: list[Pass] | None = None) -> DataFrame:
    """(paper_id, legend_id, asset_id, rule) by ordered passes over one ledger for each paper.

    blocks: paper_id, page, id, kind (legend or asset), x1, y1, x2, y2. Unpaired legends have a null asset.
    """
    passes = passes or PASSES

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        legends, assets, ledger = rows[rows.kind == "legend"], rows[rows.kind == "asset"], Ledger()
        for p in passes:
            p(legends, assets, ledger)
        made = {legend: (claimed[0], why) for why, legend, claimed, ok in ledger.journal if ok}
        paper = rows.paper_id.iloc[0]
        out = [(paper, x, *made.get(x, (None, "unmatched"))) for x in legends.id]
        return pd.DataFrame(out, columns=["paper_id", "legend_id", "asset_id", "rule"]).astype({"asset_id": "Int64"})

    return blocks.groupBy("paper_id").applyInPandas(run, "paper_id long, legend_id long, asset_id long, rule string")


def asset_clusters(assets: DataFrame, by: str, page_width: float, page_height: float) -> DataFrame:
    """(by, id, cluster): boxes of a page whose gaps are small in both directions, transitively; cluster is the least id."""
    across, down = max(0.12 * page_width, 40.0), max(0.08 * min(page_width, page_height), 40.0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        boxes = sorted(rows[["id", "x1", "y1", "x2", "y2"]].itertuples(index=False))
        root = {b.id: b.id for b in boxes}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for k, a in enumerate(boxes):
            for b in boxes[k + 1 :]:
                if max(b.x1 - a.x2, a.x1 - b.x2) <= across and max(b.y1 - a.y2, a.y1 - b.y2) <= down:
                    i, j = find(a.id), find(b.id)
                    root[max(i, j)] = min(i, j)
        return pd.DataFrame({by: rows[by].iloc[0], "id": [b.id for b in boxes], "cluster": [find(b.id) for b in boxes]})

    return assets.groupBy(by).applyInPandas(run, f"`{by}` long, id long, cluster long")
