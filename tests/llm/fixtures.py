"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, TEXT string, `n words` int, c0 string"


def prose(rng: random.Random, n: int, words: str = "the of and red fox jumps over lazy dogs near old river bank while rain falls on tin roofs") -> str:
    return " ".join(rng.choice(words.split()) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [prose(rng, 40 + 5 * i, " ".join(f"w{rng.randrange(900)}" for _ in range(300))) for i in range(12)]
    out: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, base[0]), (20, base[0])]  # copies, and a repeated row
    edited = base[3].split()
    edited[10] = "changed"
    out += [(30, " ".join(edited)), (31, base[4] + " tail"), (32, base[4].upper())]
    out += [(40, None), (41, ""), (42, "   \n\t "), (43, "one"), (44, "one two"), (None, base[5]), (None, None), (45, "é" * 30 + " 日本 語"), (46, " ".join(base) * 6)]
    out += [(50, "\n".join([base[6], base[7], "short line", base[8]])), (51, "intro words here\n" + "\n".join([base[6], base[7]]) + "\nend"), (52, "\n".join([base[9]] * 4)), (53, "a\x01b \x1f c\r\nd")]
    return out


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]], langs: dict[int, str] | None = None) -> DataFrame:
    full = [(d, t, (langs or {}).get(d, "en"), "s", len(t) if t is not None else None, 0.5, "other", 1, "x") for d, t in rows]
    spark.conf.set("spark.sql.caseSensitive", "true")
    return spark.createDataFrame(full, DOCS)


def empty(spark: SparkSession) -> DataFrame:
    return frame(spark, [])
