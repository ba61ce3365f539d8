"""A small corpus with copies, near copies, shared passages, odd texts and clashing columns."""

from __future__ import annotations

import random


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) rows."""
    rng = random.Random(seed)
    passage, texts = sentence(rng, 90), []
    for k in range(24):
        texts.append(sentence(rng, rng.randint(60, 200)))
    texts[3] = texts[2]
    texts[5] = texts[4].upper()
    near = texts[6].split()
    near[len(near) // 2] = "changed"
    texts[7] = " ".join(near)
    for k in (8, 9, 10):
        texts[k] = f"{texts[k]} {passage} {sentence(rng, 20)}"
    texts += [None, "", "   \n", "one two", "One two", "!!! 123", "é" * 50 + " ñandú ¡qué!", sentence(rng, 6000), "ab " * 400]
    rows = [(k, t, ("en", "fr", None)[k % 3], (None if k % 7 == 6 else f"s{k % 4}"), len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[11], "en", "s1", 5), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    return df.withColumns({"h": F.lit(1), "key": F.lit("x"), "size": F.lit(2), "ver": F.lit(0), "length": F.lit(0)})
