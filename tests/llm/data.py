"""Small inputs that hold the hard cases together: nulls in any column, empty
and very long texts, repeated rows, ties, and extra columns with names that
the operators use themselves."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row long, shard int, node long, score double, _email string, digest string, gone long")


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["the", "of", "and", "Été", "naïve,", "x@y.org", "10.0.0.1"]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    out = []
    for i in range(n):
        t = list(rnd.choice(base)) if rnd.random() < 0.6 else [rnd.choice(words) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 2)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append((i, rnd.choice([" ", "  ", "\n"]).join(t)))
    out += [(500, None), (501, ""), (502, " \t\n"), (None, "no id here"), (None, None), (503, "a" * 30_000),
            (504, "a" * 30_000 + "b"), (505, "one two three four"), (506, "ONE two three four"),
            (507, "long " * 9_000), out[3], out[3], out[7]]
    rnd.shuffle(out)
    return [(i, t, None, "s", None, 1, 2, 3, 0.5, "e", "d", 7) for i, t in out]


def frame(spark, seed: int = 1, n: int = 120, parts: int = 3):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
