"""Chat formatting in budgeted windows, with DataFrame functions only.

A running sum of turn tokens within a conversation (the estimate: bytes / 4 and a fixed cost a turn)
places each turn in a cell of the budget left by the system turn and the history. Turns inside a
cell make one window; a turn that crosses the end of its cell makes a window alone. So windows
are turn-aligned and no longer than the budget unless a single turn with the system turn is. Every
later window starts with the system turn and up to ``history_turns`` turns before it (within
``history_tokens`` and the budget); these are repeated, and only the first copy of an assistant's text
is under the loss mask.

A formatted window is a series of ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and
texts are broken by a backslash after their first character, and backslashes are doubled, so
reading back gives the exact text.

Defined results: null text and null role are empty; rows are ordered by turn, role and text, nulls
first, so ties and repeated rows keep a fixed order and all count; only a first turn of role
``system`` is retained, others are ordinary turns; rows with a null conv_id are one conversation; an
empty table gives an empty result. A conversation of more than ``slice_turns`` rows is worked on in slices of
about so many rows, by quantiles of the turn number, at most 1024 of them (rows of one turn number stay together).
The ``sent_conversations`` longest are found by a broadcast of 8 KB for each at most; any other holds
less than that share of all rows, so others are found by shuffles. Slices pass on sums, the system turn and the costs of their neighbours' rows, so windows do not depend on
them. ``segment_turns``, None by default, cuts conversations by turn number instead of only working in slices: a segment begins a
window with the system turn, but without history, and one that begins with a system turn of its own, when the
conversation has none, retains that. Only ``digests`` puts a whole conversation together, as one hash asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm._common import stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Starts of control strings: of this template and of common others.
_CONTROL = r"(?=<\||</?s>|\[/?INST\]|<</?SYS>>)(.)"


@dataclass(frozen=True)
class Plan:
    budget: int = 1024
    history_turns: int = 2
    history_tokens: int = 256
    turn_cost: int = 8
    least_cell: int = 64
    segment_turns: int | None = None
    slice_turns: int = 4096
    sent_conversations: int = 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column, plan: Plan) -> Column:
    return F.ceil(F.octet_length(text) / 4) + plan.turn_cost


def _segments(turns: DataFrame, plan: Plan) -> DataFrame:
    """turns with their segment, and a ghost of the system turn before each later segment."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if plan.segment_turns is None:
        return t.withColumn("seg", F.lit(0).cast("long")).withColumn("ghost", F.lit(False))
    t = t.withColumn("seg", F.coalesce(F.floor(F.col("turn") / plan.segment_turns), F.lit(-(1 << 30))).cast("long"))
    cuts = t.groupBy("conv_id", "seg").agg(F.count("*").alias("n"))
    firsts = cuts.groupBy("conv_id").agg(F.min("seg").alias("first"), F.count("*").alias("k")).where("k > 1").select(F.col("conv_id").alias("c"), "first")
    opening = t.join(firsts, t.conv_id.eqNullSafe(firsts.c) & (t.seg == firsts["first"]))
    heads = opening.groupBy("c").agg(F.min(F.struct("turn", "role", "text")).alias("h"), F.first("first").alias("first")).where("h.role = 'system'")
    later = cuts.join(heads, cuts.conv_id.eqNullSafe(heads.c) & (cuts.seg > heads["first"]))
    ghosts = later.select("conv_id", F.lit(None).cast(t.schema["turn"].dataType).alias("turn"), F.lit("system").alias("role"), F.col("h.text").alias("text"), "seg", F.lit(True).alias("ghost"))
    return t.withColumn("ghost", F.lit(False)).unionByName(ghosts)


_QUANTILES = 1024


def _order(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("ghost"), "turn", "role", "text")


def _cell(kept: Column, plan: Plan) -> Column:
    left = F.lit(plan.budget) - kept
    return F.greatest(left - plan.history_tokens, F.least(F.lit(plan.least_cell), left), F.lit(1))


def _span(before: Column, own: Column, cell: Column) -> Column:
    """The place of a turn: even inside a cell, odd across its end. It ascends, and each value is one window."""
    k = F.floor(before / cell)
    crosses = (before + own > (k + 1) * cell) & (before > k * cell)
    return k * 2 + crosses.cast("long")


def _joined(t: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", *, sent: bool = False) -> DataFrame:
    """t with other's columns besides the keys; a null conv_id is a key like others. sent: other is small and broadcast."""
    other = other.select(*(F.col(k).alias(f"{k}_") for k in keys), *(c for c in other.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return t.join(F.broadcast(other) if sent else other, on, how).drop(*(f"{k}_" for k in keys))


def _sliced(t: DataFrame, long: DataFrame, plan: Plan, sent: bool) -> DataFrame:
    """The rows of long conversations with their slice and what it must know of the others.

    sent: long has at most ``sent_conversations`` rows, so it and the cuts (8 KB for each) are broadcast.
    """
    t = _joined(t, long, ["conv_id", "seg"], sent=sent)
    quantiles = F.percentile_approx("turn", [k / _QUANTILES for k in range(1, _QUANTILES)])
    step = F.ceil(F.lit(_QUANTILES * plan.slice_turns) / F.col("rows"))
    cuts = t.groupBy("conv_id", "seg", "rows").agg(quantiles.alias("q"))
    # Stored, as a second computation could place the cuts elsewhere.
    cuts = stored(cuts.select("conv_id", "seg", F.array_distinct(F.filter("q", lambda x, i: (i + 1) % step == 0)).alias("cuts")))
    t = _joined(t.drop("rows"), cuts, ["conv_id", "seg"], sent=sent)
    t = t.withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("turn"))), F.lit(0))).drop("cuts")

    near = max(1, plan.history_turns)
    m = t.withColumn("r", F.row_number().over(_order("conv_id", "seg", "slice")))
    system = (F.col("slice") == 0) & (F.col("r") == 1) & (F.col("role") == "system")
    m = m.withColumn("cost", turn_tokens(F.col("text"), plan)).withColumn("own", F.when(system, 0).otherwise(F.col("cost")))
    edges = m.groupBy("conv_id", "seg", "slice").agg(
        F.count("*").alias("n"), F.sum("own").alias("total"), F.max_by("own", "r").alias("last"), F.max(F.when(system, F.col("text"))).alias("slice_head"), F.max(F.when(system, F.col("cost"))).alias("slice_kept"),
        *(F.max(F.when(F.col("r") == k + 1, F.col("own"))).alias(f"own{k}") for k in range(near)),
    )
    order = Window.partitionBy("conv_id", "seg").orderBy("slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0))).withColumn("base_pos", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    edges = edges.withColumn("conv_head", F.first("slice_head", ignorenulls=True).over(upto)).withColumn("conv_kept", F.coalesce(F.first("slice_kept", ignorenulls=True).over(upto), F.lit(0)))
    cell = _cell(F.col("conv_kept"), plan)
    edges = edges.withColumn("prev_span", F.lag(_span(F.col("base") + F.col("total") - F.col("last"), F.col("last"), cell)).over(order))
    firsts, before = [], F.col("base")
    for k in range(near):
        own = F.col(f"own{k}")
        firsts.append(F.when(own.isNotNull(), F.struct(_span(before, own, cell).alias("span"), before.alias("before"), own.alias("own"))))
        before = before + own
    edges = edges.withColumn("firsts", F.array_compact(F.array(*firsts)))
    nothing = F.array().cast(edges.schema["firsts"].dataType)
    edges = edges.withColumn("after", F.flatten(F.array(*(F.coalesce(F.lead("firsts", k).over(order), nothing) for k in range(1, near + 1)))))
    known = ["n", "base", "base_pos", "conv_head", "conv_kept", "prev_span", "after"]
    return _joined(t, edges.select("conv_id", "seg", "slice", *known), ["conv_id", "seg", "slice"])


def windows(turns: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(conv_id, seg, window, repeated, pos, role, text): turns of each window, repeats of earlier ones included; windows ascend from 1, with gaps."""
    t = _segments(turns, plan)
    long = stored(t.groupBy("conv_id", "seg").agg(F.count("*").alias("rows")).where(F.col("rows") > plan.slice_turns))
    n = long.count()
    if not n:
        return _windows(t, plan, False)
    if n <= plan.sent_conversations:
        most, others = long, None
    else:
        # Only the least of the greatest sizes comes to the driver.
        last = long.select("rows").orderBy(F.desc("rows")).limit(plan.sent_conversations).agg(F.min("rows")).first()[0]
        most, others = long.where(F.col("rows") > last), long.where(F.col("rows") <= last)
    short = _joined(t, most, ["conv_id", "seg"], "left_anti", sent=True)
    out = _windows(_sliced(t, most, plan, True), plan, True)
    if others is not None:
        out = out.unionByName(_windows(_sliced(short, others, plan, False), plan, True))
        short = _joined(short, others, ["conv_id", "seg"], "left_anti")
    return _windows(short, plan, False).unionByName(out)


def _windows(t: DataFrame, plan: Plan, sliced: bool) -> DataFrame:
    order = _order("conv_id", "seg", *(["slice"] if sliced else []))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("place", F.row_number().over(order)).withColumn("pos", F.col("place") + F.col("base_pos") if sliced else F.col("place"))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    t = t.withColumn("cost", turn_tokens(F.col("text"), plan)).withColumn("own", F.when(system, 0).otherwise(F.col("cost")))
    before = F.sum("own").over(running) - F.col("own")
    t = t.withColumn("before", before + F.col("base") if sliced else before)
    kept = F.col("conv_kept") if sliced else F.coalesce(F.first(F.when(system, F.col("cost")), ignorenulls=True).over(running), F.lit(0))
    t = t.withColumn("kept", kept)
    cell = _cell(F.col("kept"), plan)
    t = t.withColumn("span", _span(F.col("before"), F.col("own"), cell))
    last = F.lag("span").over(order)
    t = t.withColumn("opens", F.coalesce((F.coalesce(last, F.col("prev_span")) if sliced else last) != F.col("span"), F.lit(True)))
    t = t.withColumn("window", F.col("span") + 1)
    head = F.col("conv_head") if sliced else F.first(F.when(system, F.col("text")), ignorenulls=True).over(running)
    t = t.withColumn("head", F.when(F.col("opens") & (F.col("window") > 1) | F.col("ghost"), head))

    def copy(window: Column, pos: Column, kind: int) -> Column:
        return F.struct(window.cast("long").alias("window"), pos.cast("int").alias("pos"), F.lit(kind).alias("kind"))

    def ahead(c: str, d: int) -> Column:
        if d == 0 or not sliced:
            return F.lead(c, d).over(order) if d else F.col(c)
        return F.coalesce(F.lead(c, d).over(order), F.get("after", (d - 1 - F.col("n") + F.col("place")).cast("int"))[c])

    copies = [F.when(~F.col("ghost"), copy(F.col("window"), F.col("pos"), 0)), F.when(F.col("head").isNotNull(), copy(F.col("window"), F.lit(0), 2))]
    for d in range(1, plan.history_turns + 1):
        span = ahead("span", d)
        # What the window there may hold itself: its cell, or the turn that opens it if that is larger or stands alone.
        own = ahead("own", d)
        room = F.lit(plan.budget) - F.col("kept") - F.when(span % 2 == 1, own).otherwise(F.greatest(cell, own))
        fits = (span != ahead("span", d - 1)) & (span > F.col("span")) & (ahead("before", d) - F.col("before") <= F.least(F.lit(plan.history_tokens), room)) & ~system
        copies.append(F.when(fits, copy(span + 1, F.col("pos"), 1)))
    t = t.withColumn("copies", F.array_compact(F.array(*copies)))
    out = t.select("conv_id", "seg", "role", "text", "head", F.explode("copies").alias("c"))
    from_head = F.col("c.kind") == 2
    role, text = F.when(from_head, "system").otherwise(F.col("role")), F.when(from_head, F.col("head")).otherwise(F.col("text"))
    return out.select("conv_id", "seg", F.col("c.window").alias("window"), (F.col("c.kind") > 0).alias("repeated"), F.col("c.pos").alias("pos"), role.alias("role"), text.alias("text"))


def format_chats(turns: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(conv_id, seg, window, formatted, n_context, loss_spans), windows being numbered within segments.

    n_context counts the repeated turns at the window's start; loss_spans are ranges of code points
    of the escaped texts to learn.
    """
    lead = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    piece = F.struct(
        "pos", "repeated", F.length(lead).alias("lead"), F.length(body).alias("size"), ((F.col("role") == "assistant") & ~F.col("repeated")).alias("learnt"), F.concat(lead, body, F.lit(END)).alias("shown")
    )
    w = windows(turns, plan).groupBy("conv_id", "seg", "window").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    span = "struct<start:int,end:int>"
    none = F.array().cast(f"array<{span}>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["lead"]
        spans = F.when(x["learnt"], F.array_append(state["spans"], F.struct(start.alias("start"), (start + x["size"]).alias("end")))).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(x["shown"])).alias("at"), spans.alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("spans")), add)["spans"]
    return w.select(
        "conv_id", "seg", "window", F.array_join(F.transform("pieces", lambda x: x["shown"]), "").alias("formatted"), F.size(F.filter("pieces", lambda x: x["repeated"])).alias("n_context"), spans.alias("loss_spans")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with new_turns (role and text of the turns that are not repeats) and learnt (texts under the mask)."""
    pieces = F.split("formatted", r"<\|turn\|>", -1)
    new = F.slice(pieces, F.col("n_context") + 2, F.size(pieces))

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"<\|text\|>", 2)
        rest = F.get(parts, F.lit(1))
        return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.substring(rest, F.lit(1), F.length(rest) - len(END))).alias("text"))

    learnt = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("new_turns", F.transform(new, turn)).withColumn("learnt", learnt)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation: counts and hashes of what its windows hold."""
    said = F.array_join(F.transform("new_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("seg", "window", said.alias("said"), F.array_join("learnt", "").alias("learnt"))
    parts = F.array_sort(F.collect_list(part))
    whole = read_back(formatted).groupBy("conv_id").agg(F.sum(F.size("new_turns")).cast("long").alias("n_turns"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"), parts.alias("parts"))
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    learnt = F.array_join(F.transform("parts", lambda p: p["learnt"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars"
    )
