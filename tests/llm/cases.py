"""Small documents with hard cases, shared by the tests of this folder."""

import random

WORDS = "oil well rig deep sea pump valve crew shift log drill bit mud core sand gas flare deck crane anchor".split()


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def near(base, changes, seed=1):
    words, rng = base.split(), random.Random(seed)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def documents():
    a, b = text(1), text(2, 200)
    shared = text(3, 55)
    docs = [a, a, near(a, 1), b, near(b, 3), near(b, 20, 2), None, "", "   \n\t ", "one two", "One  TWO", "two one", a.upper(), "x" * 3000, "word " * 2000]
    docs += [f"{text(10 + k, 25)}\n{shared}\n{text(50 + k, 25)}" for k in range(6)]
    docs += [near(text(99, 80), 2, k) for k in range(12)]
    docs += ["  A repeated LINE of text here \nown " + str(k) for k in range(4)] + ["a repeated line of text here\nshort\nshort"]
    docs += ["漢字かな交じり文 ، العربية ", "don't  stop\r\n\x1c é½ <|endoftext|> x", "naïve CAFÉ ﷺ \U0001f600\U0001f600"]
    return [(i * 3 % 101 + 100 * (i // 101), t) for i, t in enumerate(docs)]


def frame(spark, rows=None, extra=True):
    """The documents, with columns whose names clash with those of results."""
    df = spark.createDataFrame(documents() if rows is None else rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", "'en' AS lang", "0 AS n_lines", "'z' AS n_tokens", "1.5 AS score", "true AS hit", "7 AS n_hit") if extra else df


def empty(spark):
    return frame(spark, []).limit(0)
