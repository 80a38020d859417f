from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.models import HashingEmbedder, ScriptedModel, embed
from loomspan.operators import rank as R
from loomspan.operators import segment as G
from loomspan.operators.review import validate
from loomspan.pipeline import expand


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_small_functions(spark):
    one = lambda s: F.lit(s)
    assert value(spark, X.clean(one(" a\x00\t b\n\nc "))) == "a b c"
    assert value(spark, X.is_insufficient(one("**insufficient_context**"))) is True
    assert value(spark, X.json_body(one('text ```json {"a": {"b": 1}} ``` end'))) == '{"a": {"b": 1}}'
    assert value(spark, X.location(F.lit(0), F.lit(3))) == "Row 3"
    assert value(spark, X.source_kind(one("a/B.PDF"))) == "pdf"
    assert value(spark, X.size_label(F.lit(2048))) == "2.0 KB"
    assert value(spark, X.terms(one("The oil of 42 of oil wells"))) == ["42", "oil", "wells"]


def test_quotes_count_code_points(spark):
    start, end = X.locate(F.lit("a😀 The  Big, well."), F.lit("big WELL"))
    assert value(spark, F.array(start, end)) == [8, 17]


def place(spark, text, quote):
    got = value(spark, F.array(*X.locate(F.lit(text), F.lit(quote))))
    return None if got[0] is None else text[got[0] : got[1]]


def test_quotes_around_dots(spark):
    text = "The crew shall keep a log. Fuel is stored on deck nine, below the crane. Été naïve."
    assert place(spark, text, "keep a LOG … stored on deck-nine below") == "stored on deck nine, below"
    assert place(spark, text, "'keep a log...stored on the roof garden'") == "keep a log"
    assert place(spark, text, "“été... NAÏVE”") == "Été naïve"  # no piece of two words: the whole
    assert place(spark, text, "crane") == "crane" and place(spark, text, "...") is None and place(spark, text, "") is None


def test_findings_move_to_where_the_quote_stands(spark):
    sections = spark.createDataFrame([(1, f"S{i}", i, t) for i, t in enumerate(["flares at night", "two tanks, one pump", "two tanks again"])], "doc_id long, section string, pos int, text string")
    passages = spark.createDataFrame([(1, 100), (2, 200)], "ordinal int, passage_id int")
    rows = [
        (1, "S0", "Two tanks", "L1", "Severe"), (2, "[S0] ", "flares AT night", " [l2] ", "x"), (3, "S2", "no such words", "L1", "info"), (4, "S9", "no such words", "L1", "low"),
        (5, "S9", "again", "[L2]", None), (6, "S0", "flares", "L3", "low"), (7, "S0", "flares", "L1x", "low"), (8, "S1", "x" * 395 + " two tanks", "L1", "low"),
    ]
    raw = spark.createDataFrame([(i, 1, *r) for i, *r in rows], "finding long, doc_id long, section string, quote string, law string, severity string")
    got = {r.finding: (r.section, r.passage_id, r.start, r.end, r.verified, r.moved, r.severity) for r in validate(raw, sections, passages).collect()}
    assert got == {
        1: ("S1", 100, 0, 9, True, True, "high"), 2: ("S0", 200, 0, 15, True, False, "medium"), 3: ("S2", 100, None, None, False, False, "low"),
        5: ("S2", 200, 10, 15, True, True, "medium"), 8: ("S1", 100, None, None, False, False, "low"),
    }


def test_numbers_of_a_million_rows(spark):
    """One number for each row, in order, though a payload makes the sampled ranges of two exchanges differ."""
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select((F.col("id") * 7919 % n).alias("k"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = G.number_rows(rows.repartition(8), ["k"])
    assert got.columns == ["k", "payload", "id"]
    assert got.agg(F.count("*"), F.count_distinct("id"), F.sum(F.abs(F.col("id") - F.col("k")))).first() == (n, n, 0)


def test_segments_of_a_text(spark):
    mark = lambda s, e, *n: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.array(*map(F.lit, n)).alias("names"))
    runs = value(spark, G.segments(F.lit("0123456789"), F.array(mark(0, 3, "a"), mark(3, 5, "b", "c"), mark(7, 8, "d"))))
    assert [tuple(r) for r in runs] == [("012", ["a"]), ("34", ["b", "c"]), ("56", None), ("7", ["d"]), ("89", None)]
    assert [tuple(r) for r in value(spark, G.segments(F.lit("abc"), F.array(mark(0, 3, "a"))))] == [("abc", ["a"])]


def test_long_texts_keep_blank_lines(spark):
    assert value(spark, G.split_long(F.lit("a\n\nb\n" + "c" * 9), 10)) == ["a\n\nb", "c" * 9]


def test_windows_of_words(spark):
    text = " ".join(map(str, range(1000)))
    got = value(spark, G.word_windows(F.lit(text)))
    assert len(got) == 3 and got[1].split()[0] == "432" and got[-1].split()[-1] == "999"
    assert value(spark, G.chunks(F.lit("too short"))) == []


def model_pack(pieces, most):
    out, cur = [], None
    for p in pieces:
        if cur is None:
            cur = p
        elif len(cur) + 1 + len(p) <= most:
            cur += " " + p
        else:
            out.append(cur)
            cur = p
    return out + ([cur] if cur is not None else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=1, max_size=9), max_size=8), min_size=1, max_size=5))
def test_packing_follows_the_model(spark, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p array<string>")
    got = df.select("i", G.pack(F.col("p"), 12, " ").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [model_pack(c, 12) for c in cases]


def headings(spark, pieces):
    return [tuple(r) for r in value(spark, G.merge_headings(F.array(*(F.struct(F.lit(p).alias("page"), F.lit(t).alias("text")) for p, t in pieces))))]


def test_headings_and_batches(spark):
    assert headings(spark, [(1, "Title"), (1, "Sub"), (1, "x" * 90), (1, "end")]) == [(1, "Title\nSub\n" + "x" * 90), (1, "end")]
    assert headings(spark, [(1, "Title"), (2, "x" * 90), (2, "a" * 50), (2, "b" * 50), (3, "c")]) == [(1, "Title"), (2, "x" * 90), (2, "a" * 50 + "\n" + "b" * 50), (3, "c")]
    assert value(spark, G.batches(F.array(*[F.lit(3000).cast("long")] * 10))) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_touching_intervals_stay_apart(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 7, 9), (2, 0, 1)], "k int, s int, e int")
    got = sorted(tuple(r) for r in G.merge_intervals(rows, "k", "s", "e", "e").collect())
    assert got == [(1, 0, 5, [5]), (1, 5, 9, [8, 9]), (2, 0, 1, [1])]


def test_mmr_prefers_what_differs(spark):
    rows = [(0, 1, 1, 0.9, [1.0, 0.0]), (0, 2, 2, 0.89, [1.0, 0.01]), (0, 3, 3, 0.6, [0.0, 1.0])]
    c = spark.createDataFrame(rows, "query_id long, id long, pos int, score double, vector array<float>")
    assert [r.id for r in R.mmr(c, k=2).orderBy("pick").collect()] == [1, 3]
    assert [r.id for r in R.mmr(c, k=2, lam=1.0).orderBy("pick").collect()] == [1, 2]
    assert [r.id for r in R.mmr(c, k=3).orderBy("pick").collect()] == [1, 2, 3]


def test_model_seams(spark):
    v = spark.createDataFrame([("oil well",), (None,)], "t string").select(embed(F.col("t"), lambda: HashingEmbedder(8)).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-6 and set(v[1].v) == {0.0}
    assert expand(ScriptedModel(["no json"]), "q") == ["q"]
    assert expand(ScriptedModel(['{"alternatives": ["a", "b", "c", "d"], "passage": "p"}']), "q") == ["q", "a", "b", "c", "p"]


def test_a_quote_is_looked_for_once(spark):
    """F8: the steps of quote_locate are not repeated for start, end and filter."""
    from loomspan.plans import registry

    plan = registry.QUERIES["quote_locate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("(?iu)") <= 2
