import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import segment as G
from loomspan.operators.long_texts import pack_rows, word_window_rows


def texts(seed, empties, n=40):
    rng = random.Random(seed)
    piece = lambda: "" if rng.random() < empties else "".join(rng.choice("abcé漢") for _ in range(rng.choice([1, 2, 3, 9, 30])))
    return [(i, [piece() for _ in range(rng.randrange(1, 60))]) for i in range(n)] + [(900, [""] * 50), (901, ["x" * 99]), (902, ["", "a", *[""] * 40, "b"])]


@pytest.mark.parametrize(("most", "joint", "empties"), [(10, " ", 0.2), (5, "\n", 0.6), (25, ", ", 0.1), (6, "", 0.4), (1, " ", 0.3)])
def test_packing_equals_the_fold(spark, most, joint, empties):
    rows = spark.createDataFrame(texts(most, empties), "k long, ps array<string>")
    want = {r.k: r.out for r in rows.select("k", G.pack(F.col("ps"), most, joint).alias("out")).collect()}
    got = {}
    packed = pack_rows(rows.select("k", F.posexplode("ps").alias("pos", "text")), ["k"], most, joint, block=1)
    for r in packed.orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.text)
    assert got == {k: v for k, v in want.items() if v}


def test_one_long_text_goes_to_several_tasks(spark):
    pieces = spark.range(60_000).selectExpr("1L AS k", "id AS pos", "repeat('ab', int(1 + id % 7)) AS text")
    packed = pack_rows(pieces, ["k"], 50, " ").cache()
    assert packed.where("length(text) > 50").count() == 0
    joined = "".join(r.text for r in packed.orderBy("pos").collect())
    assert joined.replace(" ", "") == "".join("ab" * (1 + i % 7) for i in range(60_000))
    # Greedy: no run could have taken the first piece of the next.
    texts_ = [r.text for r in packed.orderBy("pos").collect()]
    assert all(len(a) + 1 + len(b.split(" ")[0]) > 50 for a, b in zip(texts_, texts_[1:], strict=False))
    assert pack_rows(pieces.limit(0), ["k"], 50, " ").collect() == []


@pytest.mark.parametrize(("size", "overlap"), [(5, 2), (4, 0), (3, 7), (100, 10)])
def test_windows_equal_the_expression(spark, size, overlap):
    rng = random.Random(size)
    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(rng.randrange(0, 30))) + "  ") for i in range(25)], "k long, t string")
    want = {(r.k, n, t) for r in rows.select("k", G.word_windows(F.col("t"), size, overlap).alias("ws")).collect() for n, t in enumerate(r.ws)}
    assert {tuple(r) for r in word_window_rows(rows, ["k"], "t", size, overlap).collect()} == want
