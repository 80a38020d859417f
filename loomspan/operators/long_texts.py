"""Greedy packing and windows of words over rows of pieces, for texts too long for one fold.

Packing depends on where the piece before ended, so a text seems to need one pass. Here pieces are cut into blocks by number. In
each block a task finds, for every place where a packed run could start, where the next one starts (a search in prefix sums),
and follows these steps to the first start in the next block. A block holds more pieces than a run can, so steps never pass a whole block, and
the block's outcome is a small table from entries to exits. Tables of neighbouring blocks are joined in rounds that double their reach,
which gives each block its true entry; a last pass cuts the runs. Work grows with the pieces, rounds with the logarithm of the blocks.

Rules are those of ``segment.pack`` and ``segment.word_windows``: the results are the same, a row a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.functions.text import strip
from loomspan.sources.snapshot import scratch


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _steps(size: np.ndarray, own: int, most: int, joint: int) -> np.ndarray:
    """For each of the first ``own`` pieces where the run after one that starts there starts: sizes are those of a block and what follows."""
    ends = np.cumsum(size + joint)
    before = ends[:own] - size[:own] - joint
    # A run of pieces i to j has ends[j] - before[i] - joint characters; it has its first piece whatever its size.
    stop = np.searchsorted(ends, before + most + joint, "right")
    stop = np.maximum(stop, np.arange(own) + 1)
    return np.where(size[:own] == 0, np.arange(own) + 1, stop)


def _exits(step: np.ndarray, own: int) -> np.ndarray:
    """Where the steps from each place leave the block."""
    at = np.append(step, np.arange(own, max(own, int(step.max(initial=0))) + 1))
    while True:
        inside = at[:own] < own
        if not inside.any():
            return at[:own]
        at[:own] = at[at[:own]]


def pack_rows(pieces: DataFrame, keys: list[str], most: int, joint: str, *, pos: str = "pos", text: str = "text", block: int | None = None) -> DataFrame:
    """(keys, pos, text): the packed runs of pieces(keys, pos from 0 without gaps, text), each with the place of its first filled piece.

    Null pieces count as empty.
    """
    block = max(block or 4096, most + 2)
    clean = pieces.select(*keys, F.col(pos).cast("long").alias("pos"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not joint:  # then empty pieces change nothing, and without them each piece has a character
        clean = clean.where("text <> ''")
        count = Window.partitionBy(*keys, "part").orderBy("pos")
        parts = clean.withColumn("part", F.expr(f"pos div {block}"))
        sizes = parts.groupBy(*keys, "part").agg(F.count("*").alias("n"))
        base = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        clean = parts.withColumn("own", F.row_number().over(count) - 1).join(sizes.withColumn("base", base), [*keys, "part"])
        clean = clean.select(*keys, (F.col("own") + F.col("base")).alias("at"), "pos", "text")
    else:
        clean = clean.withColumn("at", F.col("pos"))
    of = F.expr(f"at div {block}")
    rows = _kept(clean.withColumn("of", of))
    # Each block also gets the pieces of the next one, as far as a run from it may reach.
    ahead = rows.where((F.col("at") >= block) & (F.col("at") % block <= most + 1)).withColumn("of", F.col("of") - 1)
    seen = rows.unionByName(ahead)
    kinds = [pieces.schema[k] for k in keys]
    steps = T.StructType([*kinds, T.StructField("entry", T.LongType()), T.StructField("exit", T.LongType())])
    runs = T.StructType([*kinds, T.StructField("pos", T.LongType()), T.StructField("text", T.StringType())])

    def sized(table: pa.Table) -> tuple[pa.Table, np.ndarray, int, int]:
        table = table.sort_by("at")
        first = table["of"][0].as_py() * block
        return table, pc.utf8_length(table["text"]).to_numpy().astype(np.int64), int((table["at"].to_numpy() < first + block).sum()), first

    def with_keys(table: pa.Table, n: int, schema: T.StructType, *columns) -> pa.Table:
        return pa.Table.from_arrays([pa.concat_arrays([table[k].combine_chunks().slice(0, 1)]).take(pa.array(np.zeros(n, np.int64))) for k in keys] + list(columns), schema=to_arrow_schema(schema))

    def exits(table: pa.Table) -> pa.Table:
        table, size, own, first = sized(table)
        out = _exits(_steps(size, own, most, len(joint)), own)
        # An entry is a place that a run of the block before can reach; the first block has one.
        entry = np.arange(min(own, most + 2) if first else 1)
        entry = entry[out[entry] < len(size)]  # others end with the text
        return with_keys(table, len(entry), steps, pa.array(first + entry), pa.array(first + out[entry]))

    def cut(table: pa.Table, entry: pa.Table) -> pa.Table:
        if not table.num_rows:
            return to_arrow_schema(runs).empty_table()
        table, size, own, first = sized(table)
        step = _steps(size, own, most, len(joint))
        places, texts, at = table["pos"].to_pylist(), table["text"].to_pylist(), (entry["entry"][0].as_py() if entry.num_rows else first + own) - first
        starts, found = [], []
        while at < own:
            if size[at]:
                starts.append(places[at])
                found.append(joint.join(texts[at : step[at]]))
            at = int(step[at])
        return with_keys(table, len(starts), runs, pa.array(starts, pa.int64()), pa.array(found, pa.string()))

    by = [*keys, "of"]
    last = rows.agg(F.max("of")).first()[0] or 0
    entries = rows.select(*keys).distinct().withColumn("entry", F.lit(0).cast("long"))
    if last:
        jump = _kept(seen.groupBy(*by).applyInArrow(exits, steps))
        reach = 1
        while True:
            new = entries.join(jump, [*keys, "entry"]).select(*keys, F.col("exit").alias("entry"))
            entries = _kept(entries.unionByName(new))
            reach *= 2
            if reach > last:
                break
            onward = jump.select(*keys, F.col("entry").alias("exit"), F.col("exit").alias("far"))
            jump = _kept(jump.join(onward, [*keys, "exit"]).select(*keys, "entry", F.col("far").alias("exit")))
    entries = entries.withColumn("of", F.expr(f"entry div {block}"))
    return seen.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(cut, runs)


def word_window_rows(texts: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """(keys, window, text): the windows of words of each text, as ``segment.word_windows`` has them, from a row a word."""
    step = max(1, size - overlap)
    words = texts.select(*keys, F.posexplode(F.split(strip(F.col(text)), r"\s+")).alias("w", "word"))
    placed = words.join(words.groupBy(*keys).agg((F.max("w") + 1).alias("n")), keys)
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("w") - size) / step) + 1).cast("int")
    held = placed.withColumn("window", F.explode(F.sequence(first, F.least(F.expr(f"w div {step}").cast("int"), last))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("w", "word"))), lambda x: x["word"])
    return held.where(F.col("w") < F.col("window") * step + size).groupBy(*keys, "window").agg(F.array_join(ordered, " ").alias("text"))
