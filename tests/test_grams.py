import numpy as np
import pytest

from loomspan.sources.grams import GramFiles, pieces, slots

WORDS = "oil gas deep well north storm crane valve Norge été 漢字".split()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(k, WORDS[k // 30], f"report {k} about {WORDS[k // 30]} number {k * 17}") for k in range(30 * len(WORDS))] + [(900, "x", None), (901, "x", "")]
    frame = spark.createDataFrame(rows, "id long, topic string, text string")
    return rows, GramFiles.write(frame, str(tmp_path_factory.mktemp("g") / "t"), ["topic", "id"], files=12)


@pytest.mark.parametrize("needle", ["about storm", "ABOUT NORGE", "été n", "漢字", "number 170", "rep", "", "no such needle", "é", "report 45"])
def test_same_rows_as_a_whole_scan(stored, needle):
    rows, texts = stored
    want = sorted(i for i, _, t in rows if t is not None and needle.lower() in t.lower())
    assert sorted(r.id for r in texts.search(needle).collect()) == want


def test_few_files_are_opened(stored):
    _, texts = stored
    every = len(texts.rows.inputFiles())
    assert every >= 8
    assert 1 <= len(texts.files("about storm")) <= 3 and len(texts.search("about storm").inputFiles()) <= 3
    assert texts.files("zzzzqq") == [] and texts.files("oil") is None


def test_grams_are_taken_of_bounded_pieces():
    """pieces of any size have all the grams of the whole texts and none besides."""
    texts = ["".join(WORDS[(k * j) % 10] for j in range(40 * k)).encode() for k in range(12)] + [b"", b"abc", b"abcd"]
    for most in (1, 5, 64, 1 << 20):
        found = list(pieces(iter(texts), most))
        assert set(np.concatenate([slots(p) for p in found]).tolist()) == set(slots(texts).tolist())
        assert max(sum(map(len, p)) for p in found) <= most + 3
