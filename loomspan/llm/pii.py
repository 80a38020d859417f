"""Personal data by weak-supervision aggregation, with DataFrame functions only.

Base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers; wider rules add
candidates (spelled-out e-mail addresses, phone numbers without a plus sign, shorter cards). Labelers
vote yes, no or nothing on each candidate: the base rule itself, gazetteers (domains, calling codes,
issuers, address ranges), words before the span, checks of form, and the characters beside it. Vote
patterns are counted per kind over all documents; expectation-maximisation over these counts (at most
4 * 3**5 rows) estimates how reliable each labeler is and how likely each pattern is personal data.
A logistic classifier over span features is then trained on the expected labels, again on counts of
feature patterns, and decides on the wider candidates. Base spans always stay.

Offsets count code points. Texts are scanned once; documents then keep their candidates in a table. The work on a text grows
with its length and nearly with the number of its spans: n spans in blocks of 128 take 64 n copies and (n / 128)^2 / 2 of blocks.

Defined results: null text counts as empty; rows that share a doc_id are reported one by one; texts
without candidates have empty lists; an empty table gives an empty result (nothing is trained).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm._common import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: A run can only begin at its first character or where the last match ended, so long runs without
#: a match are read once. Possessive loops keep Java's matcher from recursing.
_BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{{1,63}}){{1,6}}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.(/-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z/-])",
}
#: Cheap tests that a text must pass before a pattern is tried.
_NEEDS = {"email": "%@%", "phone": "%+%"}
_YES_WORDS = {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|master|amex|pay|credit|debit", "phone": r"phone|tel|call|mobile|cell|fax|contact|whatsapp"}
_NO_WORDS = r"version|isbn|order|invoice|serial|build|release|section|chapter|article|part no|sku"
_LABELERS = ("rule", "list", "words", "form", "edges")


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        x = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0) & (F.length(digits) > 0)


def small_parts(span: Column) -> Column:
    return F.forall(F.split(span, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))


def passes(kind: str, span: Column) -> Column:
    n = F.length(digits_of(span))
    if kind == "ip":
        return small_parts(span)
    if kind == "card":
        return n.between(16, 19) & luhn(digits_of(span))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


_SPAN = "struct<kind:int,start:int,end:int,text:string,before:string,after:string,base:boolean>"
#: A running fold gathers its rows in blocks of so many, as each append copies its array.
_BLOCK = 128


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, carry: Column, row_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The rows that ``step(carry, item) -> (carry, row)`` gives for the items of an array, in order."""
    none = F.array().cast(f"array<{row_type}>")

    def add(state: Column, x: Column) -> Column:
        carry, row = step(state["carry"], x)
        return F.struct(carry.alias("carry"), F.array_append(state["rows"], row).alias("rows"))

    def all_rows(xs: Column) -> Column:
        def block(state: Column, k: Column) -> Column:
            part = F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK))
            done = F.aggregate(part, F.struct(state["carry"].alias("carry"), none.alias("rows")), add)
            return _bound(done, lambda d: F.struct(d["carry"].alias("carry"), F.array_append(state["parts"], d["rows"]).alias("parts")))

        start = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{row_type}>>").alias("parts"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int"))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(blocks, start, block)["parts"])).otherwise(none)

    return _bound(items, all_rows)


def find(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """All matches of pattern, with places and what stands beside them."""

    def pieces(m: Column) -> Column:
        def piece(hit: Column, k: Column) -> Column:
            # Two characters after a match lie in the next gap and the next match, which has more than two.
            after = F.concat(F.left(F.get(m["gaps"], k + 1), F.lit(2)), F.coalesce(F.left(F.get(m["hits"], k + 1), F.lit(2)), F.lit("")))
            return F.struct(F.get(m["gaps"], k).alias("gap"), hit.alias("hit"), F.left(after, F.lit(2)).alias("after"))

        return F.transform(m["hits"], piece)

    def step(carry: Column, x: Column) -> tuple[Column, Column]:
        start = carry["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        before = F.right(F.concat(carry["tail"], x["gap"]), F.lit(32))
        row = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("text"), before.alias("before"), x["after"].alias("after"), F.lit(base).alias("base"))
        return F.struct(end.alias("at"), F.right(F.concat(before, x["hit"]), F.lit(32)).alias("tail")), row

    split = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    found = running(_bound(split, pieces), F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), _SPAN, step)
    test = text.rlike(pattern)
    if base and kind in _NEEDS:
        test = text.like(_NEEDS[kind]) & test
    return F.when(test, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def clear_of(wide: Column, base: Column) -> Column:
    """The wide spans that overlap no base span, by one sort and a fold in each direction."""
    item = f"struct<start:int,wide:boolean,end:int,span:{_SPAN}>"

    def items(spans: Column, is_wide: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_wide).alias("wide"), s["end"].alias("end"), s.alias("span")))

    def from_left(reach: Column, x: Column) -> tuple[Column, Column]:
        row = F.struct(x["start"].alias("start"), (x["wide"] & (reach <= x["start"])).alias("wide"), x["end"].alias("end"), x["span"].alias("span"), (~x["wide"]).alias("base"))
        return F.when(x["wide"], reach).otherwise(F.greatest(reach, x["end"])), row

    def from_right(next_base: Column, x: Column) -> tuple[Column, Column]:
        row = F.when(x["wide"] & (x["end"] <= next_base), x["span"])
        return F.when(x["base"], x["start"]).otherwise(next_base), row

    placed = F.sort_array(F.concat(items(base, False), items(wide, True)))
    left = running(placed, F.lit(0), item[:-1] + ",base:boolean>", from_left)
    return F.sort_array(F.array_compact(running(F.reverse(left), F.lit(2**31 - 1), _SPAN, from_right)))


def candidates(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, base, wide): spans of the base rules, and of the wider ones clear of them."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def passing(kind: str, pattern: str) -> Column:
        return F.filter(find(F.col("t"), kind, pattern, True), lambda s: passes(kind, s["text"]))

    base = [passing(k, p) for k, p in _BASE.items()]
    wide = [find(F.col("t"), k, p, False) for k, p in _WIDE.items()]
    t = t.select("doc_id", F.flatten(F.array(*base)).alias("base"), F.flatten(F.array(*wide)).alias("wide"))
    both = (F.size("wide") > 0) & (F.size("base") > 0)
    return t.select("doc_id", "base", F.when(both, clear_of(F.col("wide"), F.col("base"))).otherwise(F.col("wide")).alias("wide"))


def _by_kind(kind: Column, of: dict[str, Column], other: Column) -> Column:
    out = None
    for k, c in of.items():
        test = kind == KINDS.index(k)
        out = F.when(test, c) if out is None else out.when(test, c)
    return out.otherwise(other)


def _vote(yes: Column, no: Column) -> Column:
    """1 for yes, 0 for no, 2 for nothing."""
    return F.when(yes, 1).when(no, 0).otherwise(2)


def votes(s: Column) -> list[Column]:
    """The labelers' votes, in the order of _LABELERS."""
    kind, span, digits = s["kind"], s["text"], digits_of(s["text"])
    before = F.lower(s["before"])
    domain = F.lower(F.regexp_extract(span, r"([A-Za-z]{2,})$", 1))
    known = _by_kind(
        kind,
        {
            "email": domain.isin("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "us", "eu", "nl", "ch", "at", "be", "br", "in", "jp", "cn"),
            "ip": ~span.rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."),
            "card": digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6)"),
            "phone": span.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])") | span.rlike(r"^\(?[2-9]"),
        },
        F.lit(False),
    )
    n = F.length(digits)
    form = _by_kind(
        kind,
        {"email": F.length(span).between(6, 254) & ~span.rlike(r"\.\."), "ip": small_parts(span) & ~span.rlike(r"(?:^|\.)0[0-9]"), "card": luhn(digits), "phone": n.between(10, 13)},
        F.lit(False),
    )
    cues = _by_kind(kind, {k: before.rlike(w) for k, w in _YES_WORDS.items()}, F.lit(False))
    glued = F.right(s["before"], F.lit(1)).rlike("[A-Za-z0-9_/]") | s["after"].rlike(r"^(?:[A-Za-z0-9_@/]|[.-][0-9])")
    return [F.when(s["base"], 1).otherwise(2), _vote(known, ~known), _vote(cues, before.rlike(_NO_WORDS)), _vote(form, ~form), F.when(glued, 0).otherwise(1)]


def span_features(s: Column) -> list[Column]:
    """Small numbers that describe a span: kind, digits, separators, length, cue words, edges, form."""
    kind, span, n = s["kind"], s["text"], F.length(digits_of(s["text"]))
    marks = F.length(F.regexp_replace(span, "[A-Za-z0-9]", ""))
    v = votes(s)
    return [kind, F.least(n / 4, F.lit(4)).cast("int"), F.least(marks, F.lit(3)).cast("int"), F.least(F.length(span) / 8, F.lit(3)).cast("int"), *v[1:]]


_FEATURES = ("kind", "digits", "marks", "length", "list", "words", "form", "edges")


def aggregate_votes(patterns: dict[tuple, float], rounds: int = 50) -> tuple[dict[tuple, float], dict[tuple, float]]:
    """EM for a two-class model of (kind, votes...) counts: probability of each pattern, and reliabilities.

    A reliability is the chance of a vote, given kind, labeler and class. The start takes the share of
    yes among the votes cast; both classes keep a small pseudo-count.
    """
    share = {}
    for p in patterns:
        cast = [v for v in p[1:] if v != 2]
        share[p] = (sum(cast) + 0.5) / (len(cast) + 1)
    reliability: dict[tuple, float] = {}
    for _ in range(rounds):
        prior, table = {}, {}
        for p, n in patterns.items():
            for c, w in ((1, share[p] * n), (0, (1 - share[p]) * n)):
                prior[p[0], c] = prior.get((p[0], c), 1.0) + w
                for j, v in enumerate(p[1:]):
                    table[p[0], j, v, c] = table.get((p[0], j, v, c), 0.0) + w
        for (kind, j, _, c), _w in list(table.items()):
            total = sum(table.get((kind, j, v, c), 0.0) for v in (0, 1, 2)) + 3
            for v in (0, 1, 2):
                reliability[kind, j, v, c] = (table.get((kind, j, v, c), 0.0) + 1) / total
        new = {}
        for p in patterns:
            z = math.log(prior[p[0], 1] / prior[p[0], 0]) + sum(math.log(reliability[p[0], j, v, 1] / reliability[p[0], j, v, 0]) for j, v in enumerate(p[1:]))
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        share = new
    return share, reliability


def train_classifier(rows: list[tuple[tuple, float, float]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> dict[str, float]:
    """Logistic regression from (features, expected label, weight); weights by "name=value"."""
    total = sum(n for *_, n in rows) or 1.0
    coded = [([f"{f}={v}" for f, v in zip(_FEATURES, x, strict=True)] + ["bias"], y, n / total) for x, y, n in rows]
    w: dict[str, float] = {k: 0.0 for keys, *_ in coded for k in keys}
    for _ in range(rounds):
        g = {k: l2 * v for k, v in w.items()}
        for keys, y, n in coded:
            z = sum(w[k] for k in keys)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n
            for k in keys:
                g[k] += miss
        for k in w:
            w[k] -= rate * g[k]
    return w


def learn(found: DataFrame) -> tuple[dict[str, float], dict[tuple, float]]:
    """The span classifier and the labelers' reliabilities, from counts over all candidates."""
    spans = found.select(F.explode(F.concat("base", "wide")).alias("s"))
    s = F.col("s")
    counted = spans.select(*(c.alias(f"v{k}") for k, c in enumerate(votes(s))), *(c.alias(f"f{k}") for k, c in enumerate(span_features(s))))
    counted = counted.groupBy(*counted.columns).count().collect()  # bounded by the buckets of votes and features
    patterns: dict[tuple, float] = {}
    n_votes = len(_LABELERS)
    for r in counted:
        p = (r["f0"], *r[:n_votes])
        patterns[p] = patterns.get(p, 0.0) + r["count"]
    share, reliability = aggregate_votes(patterns)
    rows = [(tuple(r[n_votes:-1]), share[(r["f0"], *r[:n_votes])], float(r["count"])) for r in counted]
    return train_classifier(rows), reliability


def probability(s: Column, weights: dict[str, float]) -> Column:
    z = F.lit(weights.get("bias", -1.0))
    for name, c in zip(_FEATURES, span_features(s), strict=True):
        own = [(k.split("=")[1], w) for k, w in sorted(weights.items()) if k.startswith(f"{name}=")]
        if own:
            z = z + F.coalesce(F.element_at(F.create_map(*(F.lit(x) for v, w in own for x in (int(v), w))), c), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def find_personal_data(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans, as arrays of (kind, start, end) in that order."""
    found = stored(candidates(docs, text, doc_id))
    weights, _ = learn(found)
    more = F.filter("wide", lambda s: probability(s, weights) >= threshold)
    bare = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    chosen = F.when(F.size("wide") > 0, F.concat("base", more)).otherwise(F.col("base"))
    return found.select("doc_id", bare("base").alias("base"), bare(chosen).alias("spans"))


def span_list(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
