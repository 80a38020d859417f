import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import chat_format, pii, toxicity
from loomspan.llm.decontaminate import find_benchmark
from tests.llm.cases import documents, empty, frame, text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


ITEMS = [(1, text(2, 200)[:900]), (2, "One, two!"), (3, None), (4, "..."), (10, text(3, 55)), (1, "word word word"), (None, "x" * 3000)]


def brute_hits(rows):
    window = defaultdict(set)
    for i, t in ITEMS:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            window[tuple(w[k : k + 10])].add(i)
    out = {}
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in window}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in window:
                    hit.update(range(k, k + n))
                    items |= window[x]
        out[i] = (len(w), len(hit), sorted(str(x) for x in items if x is not None))
    return out


def test_decontamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (100_000, 7):  # one block, and one for each item or so
        got = {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in find_benchmark(frame(spark), items, block_windows=block).collect()}
        assert got == brute_hits(documents())
    assert find_benchmark(empty(spark), items).collect() == []
    assert all(r.n_hit == 0 for r in find_benchmark(frame(spark), items.limit(0)).collect())


def toxic_rows(n=400):
    rng = np.random.default_rng(5)
    stems = ["idiot", "moron", "scumm", "vequx"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        t = text(i, 40) + (f" {stems[rng.integers(4)]}{'es' if rng.integers(2) else ''} " if bad else " ")
        if i % 7 == 0 and bad:
            t += " the women said so."
        rows.append((i, t))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_generalises(spark):
    rows, labels = toxic_rows()
    docs, known = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    out = toxicity.score_toxicity(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [(r.score >= 0.3, r.doc_id % 5 == 0) for r in out if r.held]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    assert toxicity.score_toxicity(empty(spark), model).collect() == []
    scores = [r.score for r in toxicity.score_toxicity(frame(spark, [(1, None), (2, "")]), model).collect()]
    assert scores[0] == scores[1] and 0 <= scores[0] < 0.3
    constant = toxicity.train(docs, known.limit(0))
    assert all(abs(r.score - 1 / 22) < 1e-9 for r in toxicity.score_toxicity(docs, constant).collect())


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    """women stands in toxic rows only; with the penalty, naming women or men scores more alike."""
    rows, labels = toxic_rows()
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = frame(spark, [(1, text(1, 30) + " the women said so."), (2, text(1, 30) + " the men said so.")])
    gap = {}
    for penalty in (0.0, 20.0):
        model = toxicity.train(docs, known, penalty=penalty)
        s = {r.doc_id: r.score for r in toxicity.score_toxicity(probe, model).collect()}
        gap[penalty] = abs(s[1] - s[2])
        assert model.placed > 100
    assert gap[20.0] < 0.6 * gap[0.0]


def test_fit_equals_an_independent_one():
    """A dense matrix and Newton's method give the scores of the gradient steps; buckets stand for words and stems, but for a few that collide."""
    rows, labels = toxic_rows(300)
    y = np.array([v for _, v in labels], float)

    def named(t):
        words = re.findall("[a-z0-9]+", t.lower())
        return {(0, w) for w in words} | {(k, w[:k]) for w in words for k in (4, 5, 6) if len(w) > k}

    own = toxicity.of_texts([t for _, t in rows])
    two = [tuple(toxicity.of_texts(list(ab))) for _, t in rows for ab in toxicity.Swaps().pairs(t)]
    held, pairs = [set(f.tolist()) for f in own], [(set(a.tolist()), set(b.tolist())) for a, b in two]
    assert all(0 <= len(named(t)) - len(h) <= 1 for (_, t), h in zip(rows, held)) and sum(len(named(t)) > len(h) for (_, t), h in zip(rows, held)) < 10
    df, df1 = Counter(f for h in held for f in h), Counter(f for h, v in zip(held, y) if v for f in h)
    share = y.mean()

    def gain(a, b):
        return (a * np.log(a / b / share) if a else 0) + ((b - a) * np.log((b - a) / b / (1 - share)) if b > a else 0)

    changed = {f for a, b in pairs for f in a ^ b}
    used = [f for f, n in df.items() if n >= 3 and (gain(df1[f], n) > 2 or f in changed)]
    x = np.array([[f in h for f in used] + [1] for h in held], float)
    swap = np.array([[(f in a) - (f in b) for f in used] + [0] for a, b in pairs], float)
    assert len(swap) and np.abs(swap).sum()
    for penalty in (0.0, 1.0, 20.0):
        w, ridge = np.zeros(len(used) + 1), np.diag([3e-4] * len(used) + [0])
        w[-1] = np.log(share / (1 - share))
        bend = ridge + 2 * penalty / len(swap) * swap.T @ swap
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + bend + 1e-12 * np.eye(len(w)), x.T @ (p - y) / len(y) + bend @ w)
        model = toxicity.fit(own, y, two, penalty=penalty)
        got = np.array([1 / (1 + np.exp(-model.bias - model.weights[f].sum())) for f in own])
        assert set(np.flatnonzero(model.weights)) == set(used)
        assert np.abs(got - 1 / (1 + np.exp(-x @ w))).max() < 0.005


def test_placed_names_act_without_swapped_sentences(spark):
    """Names that stand alone in no sentence of the pairs' own: the penalty acts through names placed by themselves."""
    rows, labels = toxic_rows()
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    lists = toxicity.of_texts([t for _, t in rows])
    y = np.array([v for _, v in labels], float)
    probe = toxicity.of_texts(["the women said so", "the men said so"])
    gap = [abs(sum(m.weights[probe[0]]) - sum(m.weights[probe[1]])) for m in (toxicity.fit(lists, y, p) for p in ([], toxicity.placed_names()))]
    assert gap[1] < 0.6 * gap[0]
    model = toxicity.train(docs, known, pairs_per_row=0)
    assert model.swapped == 0 and model.placed == len(toxicity.placed_names())


def test_training_takes_one_text_and_few_pairs_of_a_document(spark):
    rows = [(1, f"the women said so. the men said no. {k}") for k in range(50)] + [(k, "plain") for k in range(2, 30)]
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 30)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), labels, pairs_per_row=1)
    assert model.swapped <= 1
    assert toxicity.train(frame(spark, rows), labels, pairs_per_row=9).swapped <= 2


def test_names_are_swapped_in_every_language(spark):
    names = [w for g in toxicity.IDENTITY_TERMS for w in g]
    assert len(names) == len(set(names))
    said = {"The women spoke.": "The men spoke", "Les Femmes parlent.": "Les hommes parlent", "Die Männer reden.": "Die mädchen reden", "Las niñas hablan.": "Las niños hablan"}
    swaps = toxicity.Swaps()
    assert {t: [b for _, b in swaps.pairs(t)] for t in said} == {t: [b] for t, b in said.items()}
    rows, labels = toxic_rows(80)
    docs = frame(spark, [(i, t.replace("the women said so", "die Frauen sagen es")) for i, t in rows])
    kept = {i for i, t in rows if "women" in t} - {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).swapped == len(kept) > 0


CHATS = [(1, 0, "system", "Be <s>kind</s> \\ [INST]"), (1, 1, "user", "hi"), (1, 2, "assistant", "a😀b </s>"), (1, 3, "user", None), (1, 4, "assistant", "<<SYS>> <|end|> x\\y")]
CHATS += [(2, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "long " * (90 * (t % 4))) for t in range(30)]
CHATS += [(3, 0, None, "no role\nline"), (3, 0, None, "no role\nline"), (4, 0, "assistant", ""), (None, 1, "assistant", "null id"), (5, 0, "tool\n|>", "<"), (5, 1, "assistant", "|turn|>"), (6, 0, "system", "only")]


def chats(spark):
    return spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(3)


def test_chat_round_trip(spark):
    turns = defaultdict(list)
    for c, t, r, x in CHATS:
        turns[c].append((t, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, rows in turns.items():
        rows.sort()
        learnt = "".join(x for _, r, x in rows if r == "assistant")
        want[c] = (len(rows), sha("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(learnt), sha(learnt))
    for segment in (4096, 4, 1):  # whole conversations, and ones cut into segments
        got = chat_format.digests(chat_format.format_chats(chats(spark), chat_format.Plan(segment_turns=segment))).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    cut = chat_format.format_chats(chats(spark), chat_format.Plan(segment_turns=2)).where("conv_id = 1").orderBy("seg", "window").collect()
    assert len(cut) == 3 and all(r.formatted.startswith("<|turn|>system<|text|>Be <") for r in cut) and [r.n_context for r in cut] == [0, 1, 1]
    assert chat_format.digests(chat_format.format_chats(chats(spark).limit(0))).collect() == []


def test_chat_windows_keep_the_budget(spark):
    plan = chat_format.Plan(budget=400, history_tokens=60)
    rows = chat_format.windows(chats(spark), plan).withColumn("cost", chat_format.turn_tokens(F.col("text"), plan))
    per = rows.groupBy("conv_id", "seg", "window").agg(F.sum("cost").alias("cost"), F.count_if(~F.col("repeated")).alias("own"), F.max("cost").alias("most"), F.count_if("repeated").alias("old")).collect()
    assert all(r.cost <= 400 or r.own == 1 for r in per)
    assert any(r.old for r in per) and max(r.old for r in per) <= 3
    controls = chat_format.format_chats(chats(spark)).where(F.col("formatted").rlike(r"</?s>|\[/?INST\]|<</?SYS>>"))
    assert controls.count() == 0


def test_chat_windows_keep_the_budget_beside_large_system_turns(spark):
    """A window is over the budget only if one of its turns and the system turn are, whatever the history."""
    rng = np.random.default_rng(8)
    rows = []
    for c, n in enumerate([0, 200, 700, 850, 960, 1010, 1100]):
        rows += [(c, -1, "system", "s" * 4 * n)] + [(c, t, "user" if t % 2 == 0 else "assistant", "x" * int(rng.integers(0, 4 * rng.choice([20, 150, 800])))) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for slices in (4096, 7):
        plan = chat_format.Plan(slice_turns=slices)
        w = chat_format.windows(turns, plan).withColumn("cost", chat_format.turn_tokens(F.col("text"), plan))
        system = F.col("role") == "system"
        per = w.groupBy("conv_id", "window").agg(F.sum("cost").alias("cost"), F.coalesce(F.max(F.when(system, F.col("cost"))), F.lit(0)).alias("kept"), F.max(F.when(~system & ~F.col("repeated"), F.col("cost"))).alias("most"), F.count_if(F.col("repeated") & ~system).alias("old"))
        per = per.collect()
        assert all(r.cost <= plan.budget or r.kept + (r.most or 0) > plan.budget for r in per)
        assert {r.old for r in per} == {0, 1, 2}


def test_chat_windows_do_not_depend_on_slices(spark):
    """Long conversations and sparse turn numbers give the windows of the plain method, history included."""
    turns = chats(spark).unionByName(chats(spark).where("conv_id = 2").withColumn("conv_id", F.lit(None).cast("long")))
    turns = turns.unionByName(spark.createDataFrame([(7, 0, "system", "be brief")], "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)))
    turns = turns.unionByName(chats(spark).where("conv_id = 2").withColumn("conv_id", F.lit(7).cast("long")).withColumn("turn", F.col("turn") + 1))
    sparse = turns.withColumn("turn", F.col("turn") * 1_000_003)

    def shown(turns, **plan):
        rows = chat_format.format_chats(turns, chat_format.Plan(budget=400, history_tokens=140, **plan)).collect()
        return sorted((str(r.conv_id), r.seg, r.window, r.formatted, r.n_context, str(r.loss_spans)) for r in rows)

    plain = shown(turns)
    assert max(r[4] for r in plain) == 3
    assert shown(sparse) == plain
    for rows in (1, 3, 7):
        assert shown(sparse, slice_turns=rows) == plain
    for sent in (1, 2):  # the longest by a broadcast, the others by shuffles
        assert shown(sparse, slice_turns=3, sent_conversations=sent) == plain
    default = chat_format.format_chats(turns).agg(F.sum(F.length("formatted"))).first()
    assert chat_format.format_chats(sparse).agg(F.sum(F.length("formatted"))).first() == default


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PRIVATE = [
    "mail a.b@c.de, x@y.z_w@v.org @none a@b 😀 q@r.s.t", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 1.2.3 0000255.1.1.1 99999999999999999999999999999999999999999.1.1.1", "card 4111 1111-1111 1111, 4111111111111111 41111111111111112222 4111  1111 5 4111111111111111",
    "call +1 (988) 555-2485 or +12 or +1.2.3.4.5.6.7.8 +123456789012345678", "a" * 30000, "1 " * 5000, "9" * 5000, "+" + "1 " * 3000, "@" * 2000, "phone: 415-555-0134 mail bob [at] example [dot] com", None, "", "card number 378282246310005", "version 1.2.3.4",
]


def test_private_spans(spark):
    rows = list(enumerate(PRIVATE))
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).select("doc_id", pii.span_list("base").alias("base"), pii.span_list("spans").alias("spans")).collect()}
    for i, t in rows:
        want = []
        for kind, p in RULES.items():
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                    want.append(f"{kind}:{m.start()}:{m.end()}")
        assert got[i].base == ",".join(want)
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert pii.find_personal_data(empty(spark)).collect() == []


def test_wider_rules_add_spans(spark):
    rows = [(i, f"please call me on phone {200 + i}-555-{1000 + i} today, or write to mail: bob{i} [at] example [dot] com") for i in range(40)] + [(100 + i, f"call +1 (988) 555-{1000 + i} and mail a{i}@b.com") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, rows)).select("doc_id", pii.span_list("spans").alias("spans")).collect()}
    assert "phone:" in got[0] and "email:" in got[0]


def test_candidates_of_texts_with_many_spans(spark):
    """More spans in a text than a block of a fold holds: places, neighbourhoods and overlaps equal brute force."""
    rng = np.random.default_rng(3)
    parts = ["a@b.co", "+1 415 555 1234", "415-555-0134", "bob [at] x [dot] com", "1.2.3.4", " ", ",", "x", "4111 1111 1111 1111", "378282246310005", "\U0001f600", "c@d.ef,", "\n"]
    rows = [(i, "".join(rng.choice(parts, n))) for i, n in enumerate([0, 1, 2, 3, 127, 128, 129, 700, 4000])]
    seen = 0
    for r in pii.candidates(frame(spark, rows), "text", "doc_id").collect():
        t = rows[r.doc_id][1]
        for x in [*r.base, *r.wide]:
            assert (x.text, x.before, x.after) == (t[x.start : x.end], t[max(0, x.start - 32) : x.start], t[x.end : x.end + 2])
        every = [x for k, p in pii._WIDE.items() for x in re.finditer(p.replace("}+", "}"), t)]
        clear = [x for x in every if not any(b.start < x.end() and x.start() < b.end for b in r.base)]
        assert [(x.start, x.end) for x in r.wide] == [x.span() for x in clear]
        seen += len(every) > len(clear) > 0
    assert seen


def test_labelers_that_agree_are_reliable():
    patterns = {(0, 1, 1, 1, 1, 1): 80.0, (0, 2, 0, 2, 0, 0): 60.0, (0, 1, 1, 2, 1, 1): 40.0, (0, 2, 1, 2, 0, 0): 5.0}
    share, reliability = pii.aggregate_votes(patterns)
    assert share[(0, 1, 1, 1, 1, 1)] > 0.99 and share[(0, 2, 0, 2, 0, 0)] < 0.01
    assert reliability[0, 3, 1, 1] > 0.9 > 0.1 > reliability[0, 3, 1, 0]


def test_columns_of_the_same_name_in_another_case_are_replaced(spark):
    import public_tokenizers

    from loomspan.llm import byte_bpe, toxicity
    from loomspan.llm.decontaminate import find_benchmark
    from loomspan.llm.line_dedup import dedup_lines
    from loomspan.llm.token_counts import count_tokens

    rows = spark.createDataFrame([(k, t, "mine", "kept") for k, t in enumerate(["a line", None, "", "x"])], "doc_id long, text string, clash string, other string")
    named = lambda c: rows.withColumnRenamed("clash", c)
    items = spark.createDataFrame([(1, "a line")], "item_id long, text string")
    model = toxicity.fit([np.array([1], np.int32), np.array([2], np.int32)], np.array([0.0, 1.0]), [])
    made = {
        "n_lines": dedup_lines(named("N_LINES")), "n_hit": find_benchmark(named("N_HIT"), items), "n_tokens": count_tokens(named("N_TOKENS"), public_tokenizers.path("byte_bpe_50k.json")),
        "score": toxicity.score_toxicity(named("SCORE"), model), "ids_sha256": byte_bpe.encode_documents(named("IDS_SHA256"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    }
    for c, out in made.items():
        assert c.upper() not in out.columns and c in out.columns
        assert out.where(f"cast({c} as string) = 'mine' or other <> 'kept'").count() == 0 and out.count() == 4
