"""What several operators share: Arrow batches gathered by size, and connected components."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.session import ship, stored

#: White space of the word rules: space, tab, \n, \v, \f, \r. Fixed value.
SPACE = r"[\x20\x09-\x0D]"

#: Bytes of an Arrow batch, so that batches of long texts stay small.
BATCH_BYTES = 2 << 20
#: Bytes of text that a task gathers before it works on them.
GATHER_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The source shipped, and Arrow batches bounded in bytes; how many rows a batch holds is
    left as it is, so that batches of short rows stay large in the caller's session too."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(setting).removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
    return ship(spark)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = GATHER_BYTES) -> Iterator[pa.Table]:
    """Arrow batches joined to tables of about limit bytes; memory stays bounded."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def binary_from(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def table_columns(df: DataFrame, needed: dict[str, Column]) -> DataFrame:
    """Only what an operator works on, under its own names, so that extra columns with
    clashing names in the input can't matter."""
    return df.select(*(c.alias(name) for name, c in needed.items()))


def each_table(f: Callable[[pa.Table], list[pa.RecordBatch] | pa.Table], limit: int = GATHER_BYTES):
    """A function for mapInArrow that applies f to gathered tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, limit):
            out = f(t)
            yield from out.to_batches(max_chunksize=4096) if isinstance(out, pa.Table) else out

    return run


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest member of each of 0..n-1's component under the (k, 2) array of links."""
    parent = np.arange(n)
    if len(pairs):
        a, b = pairs[:, 0], pairs[:, 1]
        while True:
            low = np.minimum(parent[a], parent[b])
            before = parent.copy()
            np.minimum.at(parent, before[a], low)
            np.minimum.at(parent, before[b], low)
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            if (parent == before).all():
                break
    return parent


# -- all pairs of tiles ----------------------------------------------------------------------


def order_for(total: int, most: int) -> int:
    """The least prime q for which (q + 1) of q * q + q + 1 equal parts are no more than most."""
    q = 2
    while total * (q + 1) > most * (q * q + q + 1) or any(q % k == 0 for k in range(2, math.isqrt(q) + 1)):
        q += 1
    return q


@functools.lru_cache(maxsize=8192)
def through(point: int, q: int) -> tuple[int, ...]:
    """The q + 1 lines of the projective plane of prime order q through a point, or points of
    a line; any two points share one line. Numbers stand for triples (1, a, b), (0, 1, a) and
    (0, 0, 1); a line and a point meet where their product is 0 modulo q."""
    x, y, z = (1, *divmod(point, q)) if point < q * q else (0, 1, point - q * q) if point < q * q + q else (0, 0, 1)
    if z:
        inverse = pow(z, -1, q)
        return (*(a * q + -(x + a * y) * inverse % q for a in range(q)), q * q + -y * inverse % q)
    if y:
        a = -x * pow(y, -1, q) % q
        return (*(a * q + b for b in range(q)), q * q + q)
    return (*(q * q + a for a in range(q)), q * q + q)


def home(tile: int, q: int) -> int:
    """The line on which a tile is compared with itself."""
    return min(through(tile, q))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges.

    Large-star and small-star rounds in DataFrame operations, until every node but the
    smallest of a component is linked to that one alone; each round's edges are a written
    table, of which there are never more than edges given. The number of rounds follows the
    logarithm of the longest path. Only whether it is done comes to the driver. Nulls and
    loops among the edges are left out; no edges, no rows.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), (F.col(a).isNull() | F.col(b).isNull()).alias("bad"))
    e = stored(e.filter("not bad and hi <> lo").select("hi", "lo").distinct(), "edges")
    while not _all_stars(e):
        large = _star(e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))), above=True)
        e = stored(large.distinct(), "edges")
        e = stored(_star(e, above=False).distinct(), "edges")
    stars = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _star(e: DataFrame, above: bool) -> DataFrame:
    """One star round. above: neighbours over the node go to the smallest around it; else
    the node and its neighbours below go to the smallest of them."""
    least = stored(e.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), F.least("hi", "m").alias("m")), "least")
    joined = e.join(least, e.hi == least.node)
    if above:
        return joined.filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
    return joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").unionByName(least.select(F.col("node").alias("hi"), F.col("m").alias("lo")))


def _all_stars(e: DataFrame) -> bool:
    """Whether each node is linked downwards once at most, and none both up and down."""
    if not e.groupBy("hi").count().filter("count > 1").isEmpty():
        return False
    return e.select(F.col("hi").alias("n")).join(e.select(F.col("lo").alias("n")), "n", "left_semi").isEmpty()
