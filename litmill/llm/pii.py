"""Personal data by weak supervision, with built-in DataFrame functions only.

Candidate spans come from expressions: the base kinds email, ip, card and phone, and the further kinds ssn,
local_phone and name. Five labelers vote on each candidate (1 for, -1 against, 0 abstains): a checksum or
range check, a gazetteer, words before it, the characters around it, and machine-made surroundings. The
candidates of all documents are counted by kind and votes (at most 7 * 3**5 rows); expectation-maximisation
over these counts estimates how often each labeler is right, without labels, and its posteriors train a
logistic span classifier over kind and votes. Further spans are those that the classifier accepts; base spans
that pass their own check always stay.

Matches are located without a UDF: they are wrapped in a control character (of which the text's own are first
replaced, one for one), the text is split there, and lengths are summed up. Candidates with their votes, without
the texts, are written to the shared folder: they are counted first, then judged.

Defined cases: a null or empty text has no span; spans of different kinds may overlap and are all reported;
repeated rows are treated alike; a null doc_id stays null; a text with very many matches is gone through in steps;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Workspace, pick

BASE = ("email", "ip", "card", "phone")
FURTHER = ("ssn", "local_phone", "name")
KINDS = BASE + FURTHER
LABELERS = 5
CODES = 3**LABELERS
MARK, OTHER = "\x01", "\x02"
#: Parts of a text (matches, and what lies between them) whose places are added up at once; even.
STEP = 512

# How each base kind is written. Possessive forms of the contract's expressions: each part is
# followed by a character it can't contain, so nothing would be found by giving characters back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GIVEN_NAMES = "Anna|Anne|Carlos|Charles|Claire|David|Elena|Emma|Hans|Jack|James|Jean|John|Jose|Juan|Julia|Karl|Laura|Linda|Louis|Maria|Marie|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sofia|Susan|Thomas|William"
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof)\."
LETTERS = r"[A-Z][a-z]++"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+(-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])"
NAME = rf"(?=[A-Z])(?:{TITLES} {LETTERS}(?: {LETTERS})?|(?:{GIVEN_NAMES}) {LETTERS})"
FURTHER_PATTERN = rf"(?:{SSN}|{LOCAL}|{NAME})"

#: Words that speak for a kind when they stand shortly before a span.
BEFORE = {
    "email": r"(mail|contact|write|reach|address)", "ip": r"(\bip\b|host|server|login|address|from)", "card": r"(card|visa|credit|payment|account|iban)",
    "phone": r"(phone|tel|call|mobile|fax|contact)", "ssn": r"(ssn|social|security)", "local_phone": r"(phone|tel|call|mobile|fax|contact)", "name": r"(name|dear|signed|author|by|from)\b",
}
MAIL_DOMAINS = r"(?i)[@.](?:gmail|yahoo|hotmail|outlook|icloud|proton|mail[0-9]*|example)\."
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PRIVATE_NETS = r"^(?:0|10|127|22[4-9]|2[3-5][0-9]|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CONTEXT = 30
MATCHES = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(parts: Column, some: Column, first: Column, at: Column, before: Column) -> Column:
    """Those of some of the parts that are matches: place, text, and what stands before and after.

    The first of these parts has this number, begins there and has this text before it.
    """
    empty = F.array().cast(MATCHES)

    def step(z: Column, x: Column) -> Column:
        after = F.get(parts, z.i + 1)
        after = F.left(F.when(after != "", after).otherwise(F.coalesce(F.get(parts, z.i + 2), F.lit(""))), F.lit(1))
        match = F.struct(z["at"].alias("s"), (z["at"] + F.length(x)).alias("e"), x.alias("m"), z.before.alias("before"), after.alias("after"))
        return F.struct(
            (z.i + 1).alias("i"), (z["at"] + F.length(x)).alias("at"), _last(F.concat(z.before, _last(x))).alias("before"),
            F.when(z.i % 2 == 1, F.array_append(z.out, match)).otherwise(z.out).alias("out"),
        )

    return F.aggregate(some, F.struct(first.alias("i"), at.alias("at"), before.alias("before"), empty.alias("out")), step, lambda z: z.out)


def _last(x: Column) -> Column:
    return F.right(x, F.lit(CONTEXT))


def _placed_in_steps(parts: Column) -> Column:
    """The same, STEP parts at a time, so that no list that grows is copied for each match of a long text."""
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STEP).cast("int")), lambda b: F.slice(parts, b * STEP + 1, F.lit(STEP)))
    # no CONTEXT characters hold more than so many matches and gaps
    before = lambda b: F.when(b == 0, "").otherwise(_last(F.array_join(F.transform(F.slice(parts, F.greatest(b * STEP - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)), _last), "")))

    def begun(found: Column) -> Column:
        sizes = F.transform(found, lambda step: F.aggregate(step, F.lit(0), lambda n, x: n + F.length(x)))
        begin = F.aggregate(sizes, F.array(F.lit(0)), lambda z, n: F.array_append(z, F.element_at(z, -1) + n))
        return _let(begin, lambda at: F.flatten(F.transform(found, lambda step, b: _placed(parts, step, b * STEP, F.get(at, b), before(b)))))

    return _let(steps, begun)


def spans(text: Column, pattern: str) -> Column:
    """MATCHES: the leftmost non-overlapping matches, in code points, end exclusive."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    parts = F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return _let(parts, lambda p: F.when(F.size(p) <= STEP, _placed(p, p, F.lit(0), F.lit(0), F.lit(""))).otherwise(_placed_in_steps(p)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check that decides about a base span, or that speaks for a further one."""
    n = F.length(_digits(m))
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "local_phone":
        return m.rlike(r"^\(?[2-9]")
    return F.lit(True)


def _votes(kind: str, x: Column) -> Column:
    """The labelers' votes on a candidate in base 3, as one number with its kind."""
    before = F.lower(x.before)
    around = F.concat(F.right(x.before, F.lit(1)), F.lit(" "), x.after)
    shape = {"email": x.m.rlike(r"\.[A-Za-z]{2,}$"), "name": x.m.rlike(f"^{TITLES}")}.get(kind)
    shape = valid(kind, x.m) if shape is None else shape
    known = {
        "email": x.m.rlike(MAIL_DOMAINS), "ip": ~x.m.rlike(PRIVATE_NETS), "card": x.m.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), "phone": x.m.rlike(CALLING_CODES),
        "ssn": F.lit(None).cast("boolean"), "local_phone": F.lit(None).cast("boolean"), "name": x.m.rlike(rf"\b(?:{GIVEN_NAMES})\b"),
    }[kind]
    two = lambda c: F.when(c, 2).when(~c, 0).otherwise(1)
    votes = (
        two(shape),
        two(known),
        F.when(before.rlike(BEFORE[kind]), 2).otherwise(1),
        F.when(around.rlike("[A-Za-z0-9]"), 0).otherwise(2),
        F.when(before.rlike(r"(?:[0-9a-f]{8}|[=_/\\{<]|https?:\S*)$"), 0).otherwise(1),
    )
    code = F.lit(KINDS.index(kind))
    for v in votes:
        code = code * 3 + v
    return code.cast("int")


def _found(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates: arrays of (s, e, ok, code) of each base kind, and of (s, e, code), `more`, of the further kinds."""
    text = F.col("text")
    docs = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    need = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}

    def judged(kind: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), valid(kind, x.m).alias("ok"), _votes(kind, x).alias("code"))

    def further(x: Column) -> Column:
        code = F.when(x.m.rlike("^[A-Z]"), _votes("name", x)).when(x.m.rlike("^[0-9]{3}-[0-9]{2}-"), _votes("ssn", x)).otherwise(_votes("local_phone", x))
        return F.struct(x.s.alias("s"), x.e.alias("e"), code.alias("code"))

    base = [F.when(need[k], F.transform(spans(text, PATTERNS[k]), judged(k))).alias(k) for k in BASE]
    return docs.select("doc_id", *base, F.when(text.rlike(FURTHER_PATTERN), F.transform(spans(text, FURTHER_PATTERN), further)).alias("more"))


@dataclass
class Classifier:
    """Logistic weights of kinds and votes, and what EM found about the labelers."""

    bias: list[float]
    weight: list[list[float]]  # labeler, vote
    accuracy: list[list[list[list[float]]]] = field(default_factory=list)  # kind, labeler, truth, vote

    def score(self, kind: int, votes: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias[kind] + sum(self.weight[j][v] for j, v in enumerate(votes))))))


def _unpack(code: int) -> tuple[int, tuple[int, ...]]:
    votes = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v)
    return code, tuple(reversed(votes))


def fit(counts: dict[int, int], rounds: int = 30, steps: int = 150) -> Classifier:
    """EM over counts of (kind, votes), then a classifier trained on its posteriors. The rows are at most len(KINDS) * CODES."""
    rows = [(*_unpack(c), n) for c, n in sorted(counts.items())]
    right = [0.05, 0.25, 0.7]  # at first a labeler is more often right than wrong
    p = [[[right[::-1], right] for _ in range(LABELERS)] for _ in KINDS]
    prior = [0.7] * len(KINDS)
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, votes, _n in rows:
            yes = math.log(prior[kind]) + sum(math.log(p[kind][j][1][v]) for j, v in enumerate(votes))
            no = math.log(1 - prior[kind]) + sum(math.log(p[kind][j][0][v]) for j, v in enumerate(votes))
            post.append(1 / (1 + math.exp(max(-30.0, min(30.0, no - yes)))))
        for k in range(len(KINDS)):
            of = [(votes, n, q) for (kind, votes, n), q in zip(rows, post) if kind == k]
            total = sum(n for _, n, _ in of)
            prior[k] = (sum(n * q for _, n, q in of) + 7) / (total + 10)
            for j in range(LABELERS):
                for y in (0, 1):
                    seen = [10 * (right if y else right[::-1])[v] + sum(n * (q if y else 1 - q) for votes, n, q in of if votes[j] == v) for v in range(3)]
                    p[k][j][y] = [x / sum(seen) for x in seen]
    out = Classifier([0.0] * len(KINDS), [[-1.0, 0.0, 1.0] for _ in range(LABELERS)], p)
    size = float(sum(n for *_, n in rows)) or 1.0
    for _ in range(steps):
        gb, gw = [0.0] * len(KINDS), [[0.0] * 3 for _ in range(LABELERS)]
        for (kind, votes, n), q in zip(rows, post):
            g = n / size * (q - out.score(kind, votes))
            gb[kind] += g
            for j, v in enumerate(votes):
                gw[j][v] += g
        out.bias = [b + 2 * g for b, g in zip(out.bias, gb)]
        out.weight = [[w + 2 * g for w, g in zip(ws, gs)] for ws, gs in zip(out.weight, gw)]
    return out


def train(docs: DataFrame) -> Classifier:
    """Votes are counted over all documents; only their counts come to the driver."""
    return _trained(_found(docs))


def _trained(found: DataFrame) -> Classifier:
    codes = F.concat(*[F.transform(_some(k), lambda x: x.code) for k in (*BASE, "more")])
    votes = found.select(F.explode(codes).alias("code")).groupBy("code").count()
    return fit({r.code: r["count"] for r in votes.collect()})


def _some(kind: str) -> Column:
    """Candidates of a column of _found; none where it is null."""
    ok = "" if kind == "more" else "ok:boolean,"
    return F.coalesce(kind, F.array().cast(f"array<struct<s:int,e:int,{ok}code:int>>"))


def _joined(spans_: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans_), lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def find_personal_data(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, all spans, and how many the classifier added."""
    found = Workspace(docs.sparkSession, "pii").keep(_found(docs), "found")
    model = model or _trained(found)
    accepted = [k * CODES + c for k in range(len(BASE), len(KINDS)) for c in range(CODES) if model.score(k, _unpack(c)[1]) >= 0.5]
    tagged = lambda c, at, kind: F.transform(c, lambda x: F.struct(x.s.alias("s"), at(x).alias("at"), kind(x).alias("kind"), x.e.alias("e")))
    of = lambda i, k: tagged(F.filter(_some(k), lambda x: x.ok), lambda _: F.lit(i), lambda _: F.lit(k))
    number = lambda x: F.floor(x.code / CODES).cast("int")
    names = F.array(*[F.lit(k) for k in KINDS])
    added = tagged(F.filter(_some("more"), lambda x: F.array_contains(F.lit(accepted or [-1]), x.code)), number, lambda x: F.get(names, number(x)))
    rows = found.select("doc_id", F.concat(*[of(i, k) for i, k in enumerate(BASE)]).alias("base"), added.alias("added"))
    counts = [F.size(F.filter("base", (lambda i: lambda x: x["at"] == i)(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
