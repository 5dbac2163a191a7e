"""Sharding by a k-d tree over metadata, cut at distributed weighted medians.

A node with k shards is split into floor(k / 2) and ceil(k / 2) shards at the
weighted quantile floor(k / 2) / k along its widest dimension, until each leaf
is one shard of about the target bytes. How wide a node is along a number is its
range, and along a name (language, source) how many names it holds, each as a
share of the whole table's. Each dimension of a row is one integer: the value, of
a name its hash, in the high bits and a hash of the row in the low ones, so that
ties (one source or size that a third of the rows share, rows that repeat) are
cut as evenly as anything else. Quantiles are found by histograms, narrowed until the cut is
exact or within ``TOLERANCE`` of a shard; the driver only sees ``BINS`` sums a
node, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trustloom.llm.common import stored

BINS = 1024
#: Bits of the hash below a dimension's value.
TIE_BITS = 31
#: Share of a shard's target bytes within which a cut is final.
TOLERANCE = 0.0002
#: Rows of a shard that one task numbers, about.
SLOT_ROWS = 20_000


@dataclass
class Node:
    shards: int
    first: int  #: its first shard
    where: Column | None = None
    cut: tuple[str, int] | None = None  #: dimension, and the first key that goes right
    left: Node | None = None
    right: Node | None = None


def _route(node: Node, leaf) -> Column:
    if node.cut is None:
        return leaf(node)
    dim, key = node.cut
    return F.when(F.col(dim) < F.lit(key), _route(node.left, leaf)).otherwise(_route(node.right, leaf))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.cut is None else _leaves(node.left) + _leaves(node.right)


def _cuts(rows: DataFrame, root: Node, nodes: list[Node], weights: dict[int, float], ranges: dict[int, tuple[str, int, int]], goal: float) -> None:
    """Set the cut of each of ``nodes``: one job narrows all of them at once."""
    open_ = {n.first: [ranges[n.first][0], ranges[n.first][1], ranges[n.first][2] + 1, 0.0, weights[n.first] * (n.shards // 2) / n.shards] for n in nodes}
    by = {n.first: n for n in nodes}
    while open_:
        node = _route(root, lambda n: F.lit(n.first if n.first in open_ else -1))
        bin_ = F.lit(None).cast("int")
        for first, (dim, low, high, _, _) in open_.items():
            width = max(1, -(-(high - low) // BINS))
            inside = (F.col("_node") == first) & (F.col(dim) >= F.lit(low)) & (F.col(dim) < F.lit(high))
            bin_ = F.when(inside, F.expr(f"cast(({dim} - {low}L) div {width}L as int)")).otherwise(bin_)
        counted = rows.withColumn("_node", node).withColumn("_bin", bin_).filter("_bin is not null").groupBy("_node", "_bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        found: dict[int, list] = {}
        for r in counted.collect():  # at most BINS rows a node
            found.setdefault(r["_node"], []).append((r["_bin"], r["w"], r["n"]))
        for first, (dim, low, high, before, aim) in list(open_.items()):
            width, sofar = max(1, -(-(high - low) // BINS)), before
            cut = None
            for b, w, n in sorted(found.get(first, [])):
                edge = low + b * width
                if sofar + w > aim:
                    if n == 1 or w <= TOLERANCE * goal or width == 1:
                        cut = edge if aim - sofar <= w / 2 else edge + width
                    else:
                        open_[first] = [dim, edge, min(high, edge + width), sofar, aim]
                    break
                sofar += w
            else:
                cut = high
            if cut is not None:
                n = by[first]
                n.cut = (dim, cut)
                n.left, n.right = Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)
                del open_[first]


def kd_tree(rows: DataFrame, dims: list[str], shards: int, names: tuple[str, ...] = ()) -> Node:
    """The tree over ``rows`` (the key columns ``dims`` and size); ``names`` are the dimensions without an order."""
    root = Node(shards, 0)
    total = None
    count = lambda d: F.approx_count_distinct(F.shiftright(d, TIE_BITS)) if d in names else F.lit(0)
    extent = lambda r, d: r[f"n_{d}"] - 1 if d in names else r[f"max_{d}"] - r[f"min_{d}"]
    while True:
        nodes = [n for n in _leaves(root) if n.shards > 1]
        if not nodes:
            return root
        aggs = [F.sum("size").alias("w")] + [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max), ("n", count))]
        seen = {r["_node"]: r for r in rows.withColumn("_node", _route(root, lambda n: F.lit(n.first))).groupBy("_node").agg(*aggs).collect()}
        if total is None:
            whole = {d: max(1, extent(seen[0], d)) for d in dims} if seen else {}
            total = seen[0]["w"] if seen else 0
        weights, ranges, full = {}, {}, []
        for n in nodes:
            r = seen.get(n.first)
            if r is None:  # nothing here: any cut will do
                n.cut, n.left, n.right = (dims[0], 0), Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)
                continue
            widest = max(dims, key=lambda d: extent(r, d) / whole[d])
            weights[n.first], ranges[n.first] = float(r["w"]), (widest, r[f"min_{widest}"], r[f"max_{widest}"])
            full.append(n)
        if full:
            _cuts(rows, root, full, weights, ranges, total / shards)


def _told_apart(rows: DataFrame) -> DataFrame:
    """Add tie: a hash of the row, so that shards don't hang on how the input is split.

    Only rows that repeat in every column are told apart by where they are read;
    they are each other's equals, but a third of all rows may be such.
    """
    bits = F.lit(1 << TIE_BITS)
    repeats = rows.groupBy("_row").agg(F.count("*").alias("_n")).filter("_n > 1").select("_row", F.lit(True).alias("_repeats"))
    place = F.xxhash64("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_place", place).join(repeats, "_row", "left")
    return rows.withColumn("tie", F.pmod(F.when(F.col("_repeats"), F.col("_place")).otherwise(F.xxhash64("_row")), bits)).drop("_place", "_repeats")


def _id_place(rows: DataFrame) -> Column:
    """The id as a dimension below 2^31, null first."""
    id_ = F.col("doc_id")
    if not isinstance(rows.schema["doc_id"].dataType, IntegralType):
        return F.when(id_.isNull(), 0).otherwise(F.pmod(F.xxhash64(id_), F.lit((1 << 31) - 1)) + 1)
    r = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if r["low"] is None:
        return F.lit(0)
    step = max(1, -(-(r["high"] - r["low"] + 1) // (1 << 30)))
    place = F.floor((id_.cast("decimal(20,0)") - F.lit(r["low"]).cast("decimal(20,0)")) / F.lit(step)) if step > 1 else id_.cast("long") - F.lit(r["low"])
    return F.coalesce(place.cast("long") + 1, F.lit(0))


def kd_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", shards: int | None = 40, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row in one shard, slots gapless from 0 in each.

    Ids may be of any type: of whole numbers the dimension is their place in
    their range, in steps of 2^-30 of it, and of other ids a hash.

    Give the number of shards, or ``target_bytes`` for as many as needed. The
    dimensions are the size, the language, the source and the id. Size is the
    text's UTF-8 bytes plus 16; null texts count none, and very long ones weigh
    as much as they have bytes. Null metadata sorts first. Each row is dealt by
    itself: equal texts, and rows that repeat, spread like others. Extra columns,
    whatever their names, are ignored. An empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    code = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.lit((1 << 31) - 1)) + 1, F.lit(0))
    size = (F.octet_length(t) + 16).cast("long")
    id_ = F.col(doc_id)
    rows = docs.select(
        id_.alias("doc_id"),
        size.alias("size"),
        F.xxhash64(id_, F.col(text), F.col(lang), F.col(source)).alias("_row"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.when(F.col(lang).isNull(), 0).otherwise(code(F.col(lang))).alias("_lang"),
        F.when(F.col(source).isNull(), 0).otherwise(code(F.col(source))).alias("_source"),
    )
    rows = _told_apart(stored(rows, "metadata"))
    key = lambda value: (F.least(value, F.lit((1 << 31) - 1)) * F.lit(1 << TIE_BITS) + F.col("tie")).cast("long")
    dims = {"d_size": F.col("size"), "d_lang": F.col("_lang"), "d_source": F.col("_source"), "d_id": _id_place(rows)}
    rows = stored(rows.select("doc_id", "size", "text_crc32", "tie", *[key(v).alias(k) for k, v in dims.items()]), "keys")
    if target_bytes is not None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    root = kd_tree(rows, list(dims), shards, ("d_lang", "d_source"))
    rows = rows.withColumn("shard", _route(root, lambda n: F.lit(n.first)))
    return _numbered(rows.select("doc_id", "size", "text_crc32", "shard", "tie"), shards)


def _numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Add slot: rows of a shard go to hashed buckets of about SLOT_ROWS, numbered in themselves and then offset."""
    buckets = max(4, -(-rows.count() // (shards * SLOT_ROWS)))
    rows = rows.withColumn("_bucket", F.pmod("tie", F.lit(buckets)).cast("int"))
    from pyspark.sql import Window

    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "tie")
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1).join(counts, ["shard", "_bucket"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"))
