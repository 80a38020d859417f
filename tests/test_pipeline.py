import pytest

from loomspan.models import HashingEmbedder, ScriptedModel
from loomspan.operators.search import VectorTable
from loomspan.pipeline import NOT_FOUND, NOT_RELEVANT, Pipeline, condensed, relevant

TEXTS = ["the pump runs hot", "the valve leaks oil", "lunch is at noon"]


@pytest.fixture(scope="module")
def made(spark):
    e = HashingEmbedder(64)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e.encode(TEXTS))], "id long, vector array<float>")
    return VectorTable(spark, 64).insert(points), spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"), e


def ask(spark, made, replies, question="the pump runs hot", evaluator=None, condense=False, **more):
    model = ScriptedModel(replies)
    flags = ScriptedModel([evaluator]) if evaluator is not None else None
    return Pipeline(spark, *made, model, flags, condense).query(question, **more), model


def test_answer_from_passages(spark, made):
    got, model = ask(spark, made, ["no json", "because of the fan"])
    assert got == {"answer": "because of the fan", "chunks": got["chunks"], "queries": ["the pump runs hot"], "answer_source": "knowledge_base"}
    assert got["chunks"][0] == 0 and "--- Passage 1 ---\nthe pump runs hot" in model.calls[-1][0]["content"]


def test_evaluator_drops_passages(spark, made):
    n = len(ask(spark, made, ["", "x"])[0]["chunks"])
    flags = ["true"] + ["false"] * (n - 1)
    got, _ = ask(spark, made, ["", "x"], evaluator=f"```json\n[{', '.join(flags)}]\n```")
    assert got["chunks"] == [0]
    got, _ = ask(spark, made, ["", "x"], evaluator="[true, true, true, true, true]")  # not one for each: all stay
    assert len(got["chunks"]) == n
    none = f"[{', '.join(['false'] * n)}]"
    assert ask(spark, made, [""], evaluator=none)[0] == {"answer": NOT_RELEVANT, "chunks": [], "queries": ["the pump runs hot"], "answer_source": "none"}
    got, _ = ask(spark, made, ["", "from memory"], evaluator=none, general_fallback=True)
    assert (got["answer"], got["answer_source"], got["chunks"]) == ("from memory", "general", [])


def test_insufficient_answers_fall_back(spark, made):
    for said in ("INSUFFICIENT_CONTEXT", " **insufficient_context.**"):
        assert ask(spark, made, ["", said])[0]["answer"] == NOT_FOUND
        got, _ = ask(spark, made, ["", said, "general"], general_fallback=True)
        assert (got["answer"], got["answer_source"]) == ("general", "general")


def test_nothing_found(spark, made):
    got, _ = ask(spark, made, [""], question="zzz qqq")
    assert got["answer"] == NOT_FOUND and got["chunks"] == []


def test_condensed_passages(spark, made):
    n = len(ask(spark, made, ["", "x"])[0]["chunks"])
    got, model = ask(spark, made, ["", "hot pump", *[" "] * (n - 1), "answer"], condense=True)
    assert got["chunks"] == [0] and "hot pump" in model.calls[-1][0]["content"] and "leaks" not in model.calls[-1][0]["content"]


class Failing:
    def call(self, messages):
        raise OSError


def test_models_that_fail_drop_nothing():
    assert relevant(Failing(), "q", ["a", "b"]) == [True, True] and condensed(Failing(), "q", " a ") == "a"
    assert relevant(ScriptedModel(["{}"]), "q", ["a"]) == [True]
