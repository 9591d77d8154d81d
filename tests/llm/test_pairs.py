"""Near duplicates, decontamination and line dedup against brute force."""

import hashlib
import random
import re

from litmill.llm import decontamination, lines, minhash
from tests.llm.fixtures import empty, frame, prose, texts


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, t) in enumerate(rows)]


def family(seed=3):
    """An original and copies with more and more changes, so that links lie on either side of the threshold."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((100 + i, " ".join(w)))
    return out


def passages(seed=4):
    """Texts that share half of their words, and near copies of some of them."""
    rng = random.Random(seed)
    common = " ".join(f"p{rng.randrange(5000)}" for _ in range(60))
    out = [(200 + i, common + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(50))) for i in range(12)]
    return out + [(300 + i, t.replace(t.split()[100], "swapped")) for i, t in out[:5]]


def test_near_duplicates(spark):
    for n, percent in ((3, 85), (5, 80)):
        rows = texts() + family() + passages()
        got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows), n, percent).collect()), key=str)
        want = sorted(((d, k, c, d == c) for d, k, c in components(rows, n, percent)), key=str)
        assert got == want


def test_links_across_components(spark, monkeypatch):
    """Copies of copies of one text, so that links lie between copies and not with the original."""
    rng = random.Random(8)
    base = [f"t{rng.randrange(300)}" for _ in range(100)]
    made = [base]
    for _ in range(150):
        w = list(rng.choice(made))
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"t{rng.randrange(300)}"
        made.append(w)
    sets = [shingles(" ".join(w), 3) for w in made]
    rows = [(i, len(s), i % 3, sorted(hash(x) for x in s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "class long, n long, root long, set array<long>")
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and i % 3 != j % 3 and 100 * len(a & b) >= 85 * len(a | b)}
    for hot in (512, 3):
        got = minhash.across(df, 85, minhash.Workspace(spark, "test"), hot).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    monkeypatch.setattr(minhash.join_hot, "__defaults__", (5,))  # keys of more than five rows are hot
    docs = [(i, " ".join(w)) for i, w in enumerate(made)] + [(500 + i, " ".join(made[3])) for i in range(20)]
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, docs), 3, 85).collect()))
    assert got == sorted((d, k, c, d == c) for d, k, c in components(docs, 3, 85))


def test_one_of_each_group_is_kept(spark):
    rows = texts() + family()
    docs = frame(spark, rows)
    out = minhash.keep_one(docs, 3, 85)
    assert out.columns == docs.columns
    kept = [(r[0], r[1]) for r in out.collect()]
    want = {(d, t) for (d, t), (_, _, c) in zip(rows, components(rows, 3, 85)) if d == c}
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = empty(spark)
    assert minhash.near_duplicates(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert decontamination.find(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def longest(w, v, k, p):
    n = 0
    while k + n < len(v) and p + n < len(w) and v[k + n] == w[p + n]:
        n += 1
    return n


def contaminated(rows, items, window=13):
    """By brute force; and the longest match with each item, for each document."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for d, t in rows:
        w, hit, best = split(t), set(), {}
        for i, x in items:
            v = split(x)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                z = v[k : k + window]
                for p in range(len(w) - len(z) + 1):
                    if w[p : p + len(z)] == z:
                        hit |= set(range(p, p + len(z)))
                        best.setdefault("null" if i is None else str(i), []).append((-longest(w, v, k, p), p, k))
        found = {i: min(m) for i, m in best.items()}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        most = max((-m[0] for m in found.values()), default=0)
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w), most, sorted((i, -m[0]) for i, m in found.items())))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = random.Random(5)
    rows = texts()
    long = rows[2][1].split()
    items = [(1, " ".join(long[5:30])), (2, "one two"), (3, None), (4, "..."), (5, "unseen words only"), (10, " ".join(long[8:20])), (None, rows[7][1]), (1, "one"), (6, prose(rng, 40) + " " + " ".join(long[:14])), (7, " ".join(["rep"] * 20)), (8, "rep rep"), (8, "rep rep")]
    rows += [(60, "x " + " ".join(long[5:30]).upper().replace(" ", "; ") + " y"), (61, " ".join([f"z{i}" for i in range(900)] + long[5:25])), (62, "rep " * 50), (63, "a " + "rep " * 15 + "b " + "rep " * 18 + "c"), (64, " ".join(long[5:22] + ["break"] + long[16:30]))]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(rows, items)
    for block in (10**6, 20):  # one block, then several
        found = decontamination.find(docs, bench, block=block).collect()
        assert sorted((tuple(r)[:7] for r in found), key=str) == [x[:7] for x in want]
        places = sorted(((r.doc_id, [(m.item, m.length) for m in r.matches]) for r in found), key=str)
        assert places == sorted(((x[0], x[7]) for x in want), key=str)
        split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for r in found:  # each location holds such a match
            for m in r.matches:
                assert any(split(t)[m.start : m.start + m.length] == split(x)[m["at"] : m["at"] + m.length] for d, t in rows if d == r.doc_id for i, x in items if str(i) in (m.item, "None"))
        left = sorted((r[0] for r in decontamination.remove(docs, bench, block=block).collect()), key=str)
        assert left == sorted((x[0] for x in want if not x[5]), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.remove(docs, none).count() == docs.count() and decontamination.find(docs, none).filter("contaminated").count() == 0
    assert decontamination.remove(empty(spark), bench).count() == 0


def test_suffix_array():
    import numpy as np

    rng = np.random.default_rng(2)
    for size, kinds in ((0, 1), (1, 1), (60, 2), (200, 3), (300, 40), (80, 1)):
        first = np.unique(np.concatenate([[0, size], rng.integers(0, size + 1, 4)])) if size else np.array([0, 0])
        w = rng.integers(0, kinds, size)
        left = np.concatenate([np.arange(b - a, 0, -1) for a, b in zip(first[:-1], first[1:])]).astype(np.int64)
        order = decontamination.suffix_array(w, left)
        suffixes = [w[p : p + left[p]].tolist() for p in order]
        assert sorted(order.tolist()) == list(range(size)) and suffixes == sorted(suffixes)


def test_decontamination_of_one_word_repeated():
    import time

    import pyarrow as pa

    bench = decontamination._block(["1"], [decontamination.words(*decontamination.spaced(*decontamination.flat(pa.array(["rep " * 400])), 0, 1), decontamination.lowered(decontamination.letters_digits()))[0]], 13)
    start = time.time()
    (n, hits, found), other = decontamination.examined(pa.array(["rep " * 20_000, "rep " * 12]), bench)
    assert (n, hits, [(m["item"], m["length"]) for m in found]) == (20_000, [{"a": 0, "b": 20_000}], [("1", 400)])
    assert other == (12, [], []) and time.time() - start < 20


def deleted(rows, least):
    """Line numbers inside the longest run of lines at each position that also begins earlier, of enough words."""
    units = sorted({(d is None, d or 0, d, t) for d, t in rows if t is not None}, key=lambda u: (u[0], u[1], u[3]))
    seq = []
    for k, (_, _, _, t) in enumerate(units):
        seq += [(x, k, p, len(re.findall(r"[^ \t-\r]+", x))) for p, x in enumerate(t.split("\n")) if re.search(r"[^ \t-\r]", x)]
        seq.append((object(), k, None, 0))
    gone = {}
    for i, a in enumerate(seq):
        best = 0
        for j in range(i):
            n = 0
            while i + n < len(seq) and seq[i + n][0] == seq[j + n][0]:
                n += 1
            best = max(best, n)
        if sum(s[3] for s in seq[i : i + best]) >= least:
            gone.setdefault(a[1], set()).update(range(a[2], seq[i + best - 1][2] + 1))
    return {(u[2], u[3]): gone.get(k, set()) for k, u in enumerate(units)}


def test_line_dedup(spark):
    rng = random.Random(9)
    pool = [prose(rng, n, "aa bb cc dd ee ff gg hh") for n in (3, 4, 6, 9, 14, 30, 60)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows = [r for r in texts() if r[0] is not None] + [(100 + i, t) for i, t in rows]
    for least in (50, 12):
        gone = deleted(rows, least)
        got = sorted(map(tuple, lines.dedup_lines(frame(spark, rows), least).collect()), key=str)
        want = []
        for d, t in rows:
            if t is None:
                want.append((d, 0, 0, None))
                continue
            all_ = t.split("\n")
            left = [x for p, x in enumerate(all_) if p not in gone[d, t]]
            want.append((d, len(all_), len(all_) - len(left), "\n".join(left) if gone[d, t] else t))
        assert got == sorted(want, key=str)


def test_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(lines.join_hot, "__defaults__", (3,))
    test_line_dedup(spark)


def test_documents_of_repeats_alone_go(spark):
    rng = random.Random(2)
    t = "\n".join(prose(rng, 30, " ".join(f"u{i}" for i in range(99))) for _ in range(3))
    out = lines.without_repeats(frame(spark, [(1, t), (2, t), (3, "kept\n" + t), (4, ""), (5, None)]))
    assert sorted((r[0], r[1], r[4]) for r in out.collect()) == [(1, t, len(t)), (3, "kept", 4), (4, "", 0), (5, None, None)]
