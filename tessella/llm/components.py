"""Connected components of a table of links, by union-find within partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

#: Links that one union-find holds at a time; what it can't join falls to the contraction.
BLOCK = 200_000


def forest(links: list[tuple]) -> list[tuple]:
    """(node, least node of its component) for each node that is not the least."""
    up: dict = {}

    def root(x):
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x], x = top, p
        return top

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in up]


def contract(links: DataFrame) -> DataFrame:
    """u, v: the links as stars, block by block. links: a, b of one type."""
    kind = links.schema[0].dataType
    schema = f"u {kind.simpleString()}, v {kind.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = [], None

        def out():
            stars = forest(held)
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], kinds) for i in range(2)], names=["u", "v"])

        for b in batches:
            kinds = b.column(0).type
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            if len(held) >= BLOCK:
                yield out()
                held = []
        if held:
            yield out()

    return links.mapInArrow(run, schema)


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, root: each node that has a smaller one in its component, and the smallest. links: a, b; a <> b.

    Large-star and small-star rounds, each a minimum by node with map-side combining and a join back, until every link is one from a
    node to its root. Minima are written, and sent to all tasks while they are small, so that the many links of one node need not meet in a task. The number of rounds follows the logarithm of the longest chain; nothing but counts reaches the driver."""
    edges = scratch.put(contract(links), f"{name}_0")
    files = max(1, edges.count() // 50_000)
    for turn in range(1, 64):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = small(scratch.put(least, f"{name}_least", files))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.put(large.where("u <> v").distinct(), f"{name}_large", files)
        low = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"), f"{name}_low", files)
        rest = large.join(small(low), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.put(rest.union(low.select("w", "m")).distinct(), f"{name}_{turn}", files)
        scratch.drop(f"{name}_large", f"{name}_least", f"{name}_low", f"{name}_{turn - 1}")
        edges = new
        n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == nodes and not edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
