"""Small document tables with awkward rows, shared by the tests of the operators."""

import random

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "theta", "zeta", "eta", "iota"]


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n)]


def awkward(seed: int = 1) -> list[tuple]:
    """(doc_id, text) with nulls, empty, blank and very long texts, copies, repeated rows and shared passages."""
    rng = random.Random(seed)
    shared = " ".join(words(rng, 70))
    base = words(rng, 200)
    near = list(base)
    for i in (20, 90, 150):
        near[i] = "changed"
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b "),
        (4, " ".join(base)),
        (5, " ".join(near)),
        (6, "\n".join(base)),
        (6, "\n".join(base)),
        (7, "Intro. " + shared + " end of seven"),
        (8, " ".join(words(rng, 30)) + " " + shared + " " + " ".join(words(rng, 30))),
        (9, " ".join(words(rng, 30_000))),
        (10, "same " * 400),
        (11, "same " * 60 + "but other at the end"),
        (12, "\x1c\xa0 日本語 é́ 😀 <|endoftext|> it's 'quoted' 3.14 #$%&"),
        (None, shared),
        (None, None),
        (13, "too short"),
        (13, "other text of the same id"),
    ]
    return rows + [(20 + k, " ".join(words(rng, rng.randrange(0, 120)))) for k in range(30)]


def documents(spark, rows=None, extra: bool = False):
    """A documents table; extra adds columns whose names operators use themselves."""
    rows = awkward() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in ("id", "th", "key", "n_words", "shard", "slot", "_cell", "sequence_id", "_rank", "rid", "n_tokens", "kept", "_id"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df
