"""Merkle manifest of a dataset: a digest of every row, a tree over them, and a proof for each row.

Leaves are SHA-256 digests of the rows' fields. Per group (a language) leaves ascend by id; every two
consecutive nodes become the digest of both (a lone last one the digest of itself) until one is left,
the group's subroot; subroots, ordered by group, become the root in the same way.

Large blocks of consecutive leaves are reduced where they lie, by one task each, in rounds until at most
``top`` nodes are left. The driver builds the tree over these and broadcasts, for each block, the
suffix of a proof: the siblings from the block's root up to the root. Executors then finish the
proofs: siblings inside the block, then the suffix. After several rounds only the topmost blocks
get theirs from the broadcast; lower ones get them from the blocks above by a cogroup.

Sorting is by range, so that one group may hold all rows, and rows that are alike in all fields are
dealt to several tasks. The driver gets at most ``top`` digests and a count per table.

Defined results: a null group is a group of its own, first in order; a null id comes first in its group; rows that
share group and id are ordered by their leaves; an empty table gives an empty manifest; columns that are
no fields do not matter. A leaf whose steps do not lead to the root is not verified.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.llm._common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Steps of a proof: no sibling, a sibling to the right, a sibling to the left.
LONE, RIGHT, LEFT = 0, 1, 2


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of fields one after the other: `-` for null, else bytes in UTF-8, `:` and the value."""
    shown = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]
    return F.sha2(F.concat(*parts), 256)


def _parent(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()


def _levels(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The levels above nodes, themselves first; most: as many levels above, whether or not one node is left."""
    out = [nodes]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([_parent(last[k : k + 2]) for k in range(0, len(last), 2)])
    return out


def _path(levels: list[list[bytes]], at: int) -> bytes:
    """The steps from a node of the lowest level to the highest, each a byte and perhaps a digest."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(bytes([LEFT if at & 1 else RIGHT]) + level[other] if other < len(level) else bytes([LONE]))
        at >>= 1
    return b"".join(out)


def _steps(path: bytes) -> list[tuple[int, str]]:
    out, k = [], 0
    while k < len(path):
        side = path[k]
        out.append((side, path[k + 1 : k + 33].hex() if side else ""))
        k += 33 if side else 1
    return out


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and its steps lead to."""
    for side, other in _steps(path):
        both = leaf + other if side == RIGHT else other + leaf
        leaf = hashlib.sha256(both.encode()).hexdigest()
    return leaf


def _number(rows: DataFrame) -> DataFrame:
    """rows(group, id, digest, ...) with pos, their place within the group by id and digest, and n, the size of the group."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*(F.asc_nulls_first(c) for c in ("group", "id", "digest")), F.asc("salt")]
    dealt = rows.withColumn("salt", F.rand(7)).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    kept = stored(dealt.withColumn("seq", F.monotonically_increasing_id()))
    kept = kept.withColumn("part", F.expr("seq >> 33"))
    # A count per group and task: as many rows as tasks and groups together.
    pieces = kept.groupBy("group", "part").agg(F.count("*").alias("c"), F.min("seq").alias("first"))
    whole = Window.partitionBy("group")
    before = F.sum("c").over(whole.orderBy("part")) - F.col("c")
    pieces = pieces.select(F.col("group").alias("its_group"), F.col("part").alias("its_part"), (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    match = (F.col("part") == F.col("its_part")) & F.col("group").eqNullSafe(F.col("its_group"))
    return kept.join(pieces, match).withColumn("pos", F.col("seq") + F.col("shift")).drop("seq", "part", "its_part", "its_group", "shift")


def _height(n: int) -> int:
    return max(0, (n - 1).bit_length())


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Each block of 2^bits consecutive nodes (group, pos, n, digest) as one node of the next table."""

    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, pos = rows["n"][0].as_py(), rows["pos"][0].as_py()
        root = _levels(rows["digest"].to_pylist(), min(bits, _height(n)))[-1][0]
        return pa.table({"group": rows["group"].slice(0, 1), "pos": [pos >> bits], "n": [(n + (1 << bits) - 1) >> bits], "digest": pa.array([root], pa.binary())})

    keyed = nodes.select("group", "pos", "n", "digest", F.expr(f"pos >> {bits}").alias("block"))
    return keyed.groupBy("group", "block").applyInArrow(reduce, "group string, pos long, n long, digest binary")


def _top_paths(held: list) -> tuple[str | None, dict[tuple, tuple[str, bytes]]]:
    """From the nodes (group, pos, digest) that the driver holds: the root, and each node's subroot and steps to the root."""
    own: dict = {}
    for r in sorted(held, key=lambda r: r.pos):
        own.setdefault(r.group, []).append(bytes(r.digest))
    groups = sorted(own, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _levels(own[g]) for g in groups}
    upper = _levels([trees[g][-1][0] for g in groups])
    out = {}
    for at, g in enumerate(groups):
        rest = _path(upper, at)
        for pos in range(len(own[g])):
            out[g, pos] = trees[g][-1][0].hex(), _path(trees[g], pos) + rest
    return (upper[-1][0].hex() if groups else None), out


def _descend(nodes: DataFrame, bits: int, found, names: list[str], schema: str, make) -> DataFrame:
    """What ``make(values of names, subroot, path)`` gives for each node, block by block.

    found: a broadcast of each block's subroot and steps to the root, or a table (group, pos, subroot, path) of them.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def finish(rows: pa.Table, subroot: str, suffix: bytes) -> pa.Table:
        rows = rows.sort_by("pos")
        levels = _levels(rows["digest"].to_pylist(), min(bits, _height(rows["n"][0].as_py())))
        values = zip(*(rows[c].to_pylist() for c in names), strict=True)
        made = zip(*(make(v, subroot, _path(levels, at) + suffix) for at, v in enumerate(values)), strict=True)
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(made, kinds, strict=True)], schema=kinds)

    def from_broadcast(rows: pa.Table) -> pa.Table:
        return finish(rows, *found.value[rows["group"][0].as_py(), rows["block"][0].as_py()])

    def from_table(rows: pa.Table, above: pa.Table) -> pa.Table:
        return finish(rows, above["subroot"][0].as_py(), above["path"][0].as_py())

    keyed = nodes.withColumn("block", F.expr(f"pos >> {bits}")).groupBy("group", "block")
    if isinstance(found, DataFrame):
        return keyed.cogroup(found.withColumnRenamed("pos", "block").groupBy("group", "block")).applyInArrow(from_table, schema)
    return keyed.applyInArrow(from_broadcast, schema)


def prove(leaves: DataFrame, *, block_bits: int = 12, top: int = 16384, extra: str = "") -> DataFrame:
    """(id, leaf, subroot, root, path, and the columns that the DDL ``extra`` names) of leaves(id, group string, leaf, ...).

    path holds a proof's steps in bytes: ``proof_digest`` and ``folded`` read it.
    """
    spark = leaves.sparkSession
    more = [c.split()[0] for c in extra.split(", ")] if extra else []
    tables = [_number(leaves.select("id", "group", F.unhex("leaf").alias("digest"), *more))]
    while True:
        tables.append(stored(_blocks(tables[-1], block_bits), narrow=True))
        size = tables[-1].agg(F.count("*").alias("nodes"), F.max("n").alias("n")).first()
        if size.nodes <= top or size.n == 1:
            break
    if size.nodes <= top:
        root, paths = _top_paths(tables[-1].collect())
        found = spark.sparkContext.broadcast(paths)
    else:  # more groups than the driver takes: their subroots are the leaves of one more tree
        named = tables[-1].select(F.col("group").alias("id"), F.lit(None).cast("string").alias("group"), F.lower(F.hex("digest")).alias("leaf"))
        upper = stored(prove(named, block_bits=block_bits, top=top))
        root = upper.select("root").first()[0]
        found = upper.select(F.col("id").alias("group"), F.lit(0).cast("long").alias("pos"), F.col("leaf").alias("subroot"), "path")
    for table in tables[-2:0:-1]:
        found = stored(_descend(table, block_bits, found, ["group", "pos"], "group string, pos long, subroot string, path binary", lambda v, subroot, path: (*v, subroot, path)))
    schema = f"id {leaves.schema['id'].dataType.simpleString()}, leaf string, subroot string, path binary" + (f", {extra}" if extra else "")
    out = _descend(tables[0], block_bits, found, ["id", "digest", *more], schema, lambda v, subroot, path: (v[0], v[1].hex(), subroot, path, *v[2:]))
    return out.select("id", "leaf", "subroot", F.lit(root).alias("root"), "path", *more)


@F.pandas_udf(T.StringType())
def proof_digest(path: pd.Series) -> pd.Series:
    """SHA-256 of a proof's siblings as hex text, from the leaf up."""
    return path.map(lambda p: hashlib.sha256("".join(other for _, other in _steps(p)).encode()).hexdigest())


@F.pandas_udf(T.StringType())
def folded(leaf: pd.Series, path: pd.Series) -> pd.Series:
    """The root that a leaf and the siblings of a proof lead to."""
    return pd.Series([fold(x, p) for x, p in zip(leaf, path, strict=True)])


def manifest(docs: DataFrame, *, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, extra: dict[str, Column] | None = None, **sizes) -> DataFrame:
    """(id, leaf, subroot, root, path) of each row of docs; ``extra`` adds string columns of docs under new names."""
    own = {f"extra_{k}": c.cast("string") for k, c in (extra or {}).items()}
    leaves = docs.select(F.col(doc_id).alias("id"), F.col(group).cast("string").alias("group"), leaf_digest([F.col(c) for c in fields]).alias("leaf"), *(c.alias(k) for k, c in own.items()))
    out = prove(leaves, extra=", ".join(f"{k} string" for k in own), **sizes)
    return out.withColumnsRenamed({k: k.removeprefix("extra_") for k in own})


def tampered(doc_id: Column) -> Column:
    """Whether the audit of ``audited`` changes this row: 7 divides the CRC-32 of the id in decimal."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def audited(docs: DataFrame, **sizes) -> DataFrame:
    """The manifest of docs with an audit of each row against it, where some rows have one n_chars more than they had."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = leaf_digest([more if c == "n_chars" else F.col(c) for c in FIELDS])
    out = manifest(docs, extra={"changed": F.when(tampered(F.col("doc_id")), changed)}, **sizes)
    out = out.withColumn("proof_sha256", proof_digest("path")).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), "path"))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
