"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, columns with clashing names."""

from __future__ import annotations

import random

LONG = " ".join(f"word{random.Random(1).randrange(900)}x{i % 700}" for i in range(30_000))
BASE = [f"alpha{i} beta{i % 7}" for i in range(60)]

TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "One",
    "a b c d",
    "A B C D",
    "a b c d e",
    "x" * 5000,
    " ".join(BASE),
    " ".join(BASE),
    " ".join(BASE[:-1] + ["other words"]),
    " ".join(BASE).upper(),
    " ".join(BASE * 4),
    "same line\nsame line\nsame line\nother\nsame line ",
    "é ü ñ ß 漢字 🙂 word stays one",
    "a\u0000b nul",
    LONG,
    LONG + " tail",
    "### $$$ %%% *** | < > & word",
]

CLASH = "id bigint, words string, n_words string, kept string, component_id string, score string, size int, shard string, unit string, _mix string, _quality int"


def documents(spark, texts=TEXTS, repeat: int = 2):
    """Each text once, the last rows ``repeat`` times with equal ids, and a few rows with null ids."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}") for i, t in enumerate(texts)]
    rows += [r for r in rows[-2:] for _ in range(repeat - 1)]
    rows += [(None, None, None, None), (None, texts[9], "de", "src1"), (None, texts[9], "de", "src1")]
    rows = [(*r, None, 5, "w", "n", "k", "c", "s", 1, "h", "u", "m", 3) for r in rows]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}").repartition(3)


def empty(spark):
    return documents(spark).where("false")
