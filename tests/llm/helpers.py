"""Small frames with every awkward kind of row."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema).coalesce(2)


def documents(spark, texts):
    """Documents 0, 1, ... of these texts; a pair is (id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return frame(spark, [(i, t, "en", "src", len(t or "")) for i, t in rows])


def prose(seed, n, size=2000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


ODD = [None, "", " \t\n", "a", "a a a a a a", "x " * 30000, "é ß İ Σ 漢字 😀 \x1c \x85 \u00a0 end", "same text here", "same text here"]
