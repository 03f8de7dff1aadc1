"""Small documents for the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tu", "ves", "zor", "pa") for b in ("la", "nd", "st", "mo", "ri", "ux", "ig", "")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def frame(spark, texts, start=1):
    rows = [(k, t, "en", "src0", len(t) if t is not None else None) for k, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(rng: random.Random) -> list:
    """Null, empty and blank texts, one word, odd white space, repeats, other scripts, and a long text."""
    return [None, "", "   \n\t", "one", "one", "a\x0bb\x0cc\td e f", "é è ß ü", "\u00a0not a blank\u00a0", "x" * 5000, sentence(rng, 6000), "The THE the the THE the", "\U0001f600 \U0001f600"]
