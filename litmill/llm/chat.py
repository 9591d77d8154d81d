"""Chat formatting with a loss mask found by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what a prefix adds is its last turn's span. An output that doesn't begin with
the one before shows that the template rewrites its history; such a conversation is reported and has no
mask. Inside a span, the turn is rendered with two probe texts in place of its own; what these outputs share
at either end is the turn's frame, so what remains is its content.

The marked template writes '### role: text</turn>' and a line end for each turn, with a backslash before every
backslash, number sign, less-than sign and (in roles) colon of the data, so that no text can forge a control
string and reading is exact.

Conversations are grouped by conv_id: one shuffle of the table. A prefix is rendered for each turn, which
takes time with the square of a conversation's length but only one conversation's memory.

Defined cases: a null text or role is empty; rows with equal conv_id and turn follow in the order of role,
then text, nulls first; repeated rows are repeated turns; a null turn comes first; rows with a null
conv_id form one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import pick

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

FORMATTED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, loss_spans array<struct<a:int,b:int>>, rewrites_history boolean"

_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


def escape(text: str, also: str = "") -> str:
    return re.sub(rf"[\\#<{also}]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked(turns: Turns) -> str:
    return "".join(f"### {escape(role, ':')}: {escape(text)}</turn>\n" for role, text in turns)


def read(formatted: str) -> Turns:
    """The turns of a text that the marked template wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def content_spans(template: Template, turns: Turns) -> tuple[str, list[tuple[int, int]] | None]:
    """The formatted conversation and where each turn's text stands in it; None if the template rewrites its history."""
    before, spans = template([]), []
    for i in range(1, len(turns) + 1):
        out = template(turns[:i])
        if not out.startswith(before):
            return template(turns), None
        role = turns[i - 1][0]
        a, b = (template([*turns[: i - 1], (role, probe)]) for probe in ("x", "yy"))
        head = _shared(a, b)
        tail = _shared(a[::-1], b[::-1])
        if head < len(before) or len(a) - tail < head:
            return template(turns), None
        spans.append((head, len(out) - tail))
        before = out
    return before, spans


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    turn = F.struct("turn", "role", "text")
    return pick(rows, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, template: Template = marked, reader: Callable[[str], Turns] = read, loss_role: str = "assistant") -> DataFrame:
    """Each conversation formatted, with its loss mask and digests of what is read back from the output."""

    def formatted(turns: Turns) -> dict:
        out, spans = content_spans(template, turns)
        back = reader(out)
        mask = [s for s, (role, _) in zip(spans or [], back) if role == loss_role]
        loss = "".join(unescape(out[a:b]) for a, b in mask)
        return {
            "n_turns": len(back), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest(),
            "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(out),
            "formatted": out, "loss_spans": [{"a": a, "b": b} for a, b in mask], "rewrites_history": spans is None,
        }

    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("formatted", pa.string()), ("loss_spans", span), ("rewrites_history", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [{"conv_id": c} | formatted([(t["role"] or "", t["text"] or "") for t in turns]) for c, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return conversations_of(rows).mapInArrow(run, FORMATTED)
