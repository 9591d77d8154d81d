"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions at its hits, then checksums.

One automaton finds the keywords of all kinds in a lower-cased copy of the text; each kind's expression is
then matched only where one of its keywords stands (its whole match begins there). Kinds with a checksum inside (a
CRC-32 in base 62) are kept only if it holds, and are the ones counted as verified; a signed token is kept if its
header is a JSON object that names an algorithm. Long hexadecimal runs have no keyword: they are found by their length.

Base kinds are `assign`, `access` and `hex`: leftmost, non-overlapping matches, of which the too short are
dropped without another try. The further kinds only add spans.

Defined cases: a null or empty text has no span; repeated rows are scanned alike; a null doc_id stays null;
overlapping spans of different kinds are all reported; a very long text is scanned whole, in time linear in its length;
a header that is nested too deeply to be read is none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from litmill.llm.common import flat, pick

BASE_KINDS = ("assign", "access", "hex")
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_verified long"

HEX = re.compile(rb"[0-9a-f]{24,}")


def _base62_crc(token: bytes) -> bool:
    """The last six characters are the CRC-32 of the random part in base 62."""
    digits, body, tail = string.digits + string.ascii_uppercase + string.ascii_lowercase, token[token.index(b"_") + 1 : -6], token[-6:]
    value = 0
    for c in tail.decode():
        value = value * 62 + digits.index(c)
    return value == zlib.crc32(body)


def _header(token: bytes) -> bool:
    """The first part is a JSON object that names an algorithm."""
    part = token.split(b".")[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


@dataclass
class Rule:
    kind: str
    keywords: tuple[str, ...]  # lower-cased; a match begins with one of them
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    checksum: bool = False


RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(rb"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda m: len(m[1]) >= 6,
    ),
    Rule("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _base62_crc(m[0]), True),
    Rule("npm", ("npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _base62_crc(m[0]), True),
    Rule("jwt", ("eyj",), re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), lambda m: _header(m[0])),
    Rule("pem", ("-----begin ",), re.compile(rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), lambda m: True),
)
KINDS = BASE_KINDS + tuple(r.kind for r in RULES if r.kind not in BASE_KINDS)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, rule in enumerate(RULES):
        for word in rule.keywords:
            a.add_word(word, (k, len(word)))
    a.make_automaton()
    return a


def scan(text: bytes, find: ahocorasick.Automaton) -> tuple[list[tuple[str, int, int]], int]:
    """(kind, start, end) of each span in bytes, and how many passed a checksum."""
    spans, verified = [], 0
    at: dict[int, list[int]] = {}
    for end, (k, size) in find.iter(text.lower().decode("latin-1")):
        at.setdefault(k, []).append(end - size + 1)
    for k, starts in at.items():
        rule, done = RULES[k], 0
        for start in sorted(starts):
            if start >= done and (m := rule.pattern.match(text, start)):
                done = m.end()
                if rule.valid(m):
                    spans.append((rule.kind, start, m.end()))
                    verified += rule.checksum
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)], verified


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(kind, int(begins[a]), int(begins[b])) for kind, a, b in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts of the base kinds, their digest, all spans, and how many passed a checksum."""

    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            raw, off = flat(batch.column(1))
            data = memoryview(raw)
            rows = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                text = bytes(data[a:b])
                spans, verified = scan(text, find)
                if not spans:
                    rows.append((0, 0, 0, nothing, "", 0))
                    continue
                spans = in_code_points(text, spans)
                base = [s for s in spans if s[0] in BASE_KINDS]
                rows.append((*[sum(s[0] == k for s in base) for k in BASE_KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), verified))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[c.split()[0] for c in SCANNED.split(", ")])

    return pick(docs, "doc_id", "text").mapInArrow(run, SCANNED)
