"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are one class, and vectors of each length are compared among themselves. Unit
vectors are rotated onto principal axes, so that most of a product's size comes first, and
classes are dealt into tiles by ranges of the first two coordinates. A comparison of two
tiles accumulates leading dimensions for all pairs at once, bounds what the rest can add by
the norms of the suffixes, and goes on with the pairs that can still reach the threshold;
those left are decided by the cosine of the vectors themselves in double precision. Tiles
whose leading coordinates lie further apart than linked vectors can are not compared.

Tiles are the points and tasks the lines of a projective plane: any two tiles meet in exactly
one task. With q + 1 tiles in a task, q * q + q + 1 tiles and as many tasks, each vector is
copied q + 1 times at most, half as often as where each pair of tiles is a task of the same
size; q is the least prime that keeps a task's vectors below TASK_BYTES.

A task returns the number of links of each vector and a spanning forest of them, never all
pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import components, home, order_for, ready, roots, table_columns, through
from caselens.session import stored

COSINE = 0.95
#: Classes of one length that are one tile; more are dealt into tiles.
TILE = 2048
#: Bytes of vectors in a task, at most, whatever the number of vectors.
TASK_BYTES = 128 << 20
#: Vectors that the axes are taken from. Any axes are right; these make products end early.
AXES_SAMPLE = 4096
#: Leading dimensions of the first and second product, as shares of all.
LEADING, MIDDLE = 0.25, 0.5
#: Leading coordinates by which tiles are told to be too far apart.
COORDINATES = 4
#: Products of leading dimensions are in single precision.
SLACK = 1e-5
#: Parts that a class's rows are dealt into.
SALTS = 32


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision over their largest component, so that no square overflows or
    vanishes."""
    rows = rows.astype(float)
    return rows / np.abs(rows).max(axis=1)[:, None]


def unit(rows: np.ndarray) -> np.ndarray:
    u = scaled(rows)
    return u / np.sqrt((u * u).sum(axis=1))[:, None]


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, kind: str) -> np.ndarray:
    """Vectors of one length, from a column of their bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [np.frombuffer(p.buffers()[2], kind, count=len(p) * dims, offset=np.frombuffer(p.buffers()[1], np.int32, 1, 4 * p.offset)[0]).reshape(-1, dims) for p in parts if len(p)]
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros((0, dims), kind)


# -- comparing -----------------------------------------------------------------------------------


class Tile:
    """Vectors by their first coordinate: rotated and cut off at the middle, in single
    precision, with the norms of what is cut off."""

    def __init__(self, x: np.ndarray, axes: np.ndarray | None, block: int = 4096):
        dims = x.shape[1]
        self.lead = max(1, math.ceil(LEADING * dims))
        self.mid = max(self.lead, math.ceil(MIDDLE * dims))
        r, s = np.empty((len(x), self.mid), np.float32), np.empty((len(x), 2), np.float32)
        for i in range(0, len(x), block):
            u = unit(x[i : i + block])
            u = u if axes is None else u @ axes
            r[i : i + block] = u[:, : self.mid]
            s[i : i + block, 0] = np.sqrt((u[:, self.lead :] ** 2).sum(axis=1))
            s[i : i + block, 1] = np.sqrt((u[:, self.mid :] ** 2).sum(axis=1))
        self.order = np.argsort(r[:, 0], kind="stable")
        self.x, self.r, self.s = x, r[self.order], s[self.order]
        self.first = self.r[:, 0]
        self.leading = np.hstack([self.r[:, : self.lead], self.s[:, :1]])  # the product of the suffix norms is one more dimension


def linked(a: Tile, b: Tile, cosine: float, block: int = 1024) -> np.ndarray:
    """(row of a, row of b) pairs of at least the cosine; each pair once where a is b."""
    reach, out = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK, []
    for i in range(0, len(a.order), block):
        low, high = np.searchsorted(b.first, (a.first[i] - reach, a.first[min(i + block, len(a.order)) - 1] + reach))
        low = max(low, i) if a is b else low
        for j in range(low, high, 16 * block):
            x, y = np.nonzero(a.leading[i : i + block] @ b.leading[j : min(j + 16 * block, high)].T >= cosine - SLACK)
            x, y = x + i, y + j
            if a is b:
                x, y = x[x < y], y[x < y]
            for s in range(0, len(x), 100_000):
                p, q = x[s : s + 100_000], y[s : s + 100_000]
                keep = np.einsum("ij,ij->i", a.r[p], b.r[q]) + a.s[p, 1] * b.s[q, 1] >= cosine - SLACK
                p, q = a.order[p[keep]], b.order[q[keep]]
                u, v = scaled(a.x[p]), scaled(b.x[q])
                norms = np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v))
                keep = np.einsum("ij,ij->i", u, v) / norms >= cosine
                out.append(np.column_stack([p[keep], q[keep]]))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


class Tiling:
    """How classes of one length are dealt: axes, ranges of the first coordinate and of the
    second within each, and the box of leading coordinates of each tile. It grows with the
    number of tiles, by a few numbers for each."""

    def __init__(self, axes: np.ndarray, q: int, cuts: np.ndarray, inner: list[np.ndarray]):
        self.axes, self.q, self.cuts, self.inner = axes, q, cuts, inner
        self.starts = np.cumsum([0, *(len(c) + 1 for c in inner)])
        self.low = self.high = None
        self.known: dict[int, list[int]] = {}

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return unit(x) @ self.axes[:, :COORDINATES]

    def tiles(self, c: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Equal coordinates are told apart by a jitter far below the slack of ranges."""
        c = c + (jitter(ids)[:, None] if c.shape[1] > 1 else 0)
        outer = np.searchsorted(self.cuts, c[:, 0])
        out = np.empty(len(c), dtype=np.int64)
        for k in np.unique(outer):
            rows = outer == k
            out[rows] = self.starts[k] + np.searchsorted(self.inner[k], c[rows, min(1, c.shape[1] - 1)])
        return out

    def near(self, tile: int, others: np.ndarray, cosine: float) -> np.ndarray:
        """Whether boxes are no further apart than linked unit vectors may be."""
        gap = np.maximum(0, np.maximum(self.low[others] - self.high[tile], self.low[tile] - self.high[others]))
        return np.sqrt((gap * gap).sum(axis=1)) <= math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK

    def tasks(self, tile: int, cosine: float) -> list[int]:
        """The lines through a tile on which it meets one near enough, and its home."""
        if tile not in self.known:
            own, there = home(tile, self.q), len(self.low)
            self.known[tile] = [line for line in through(tile, self.q) if line == own or self.near(tile, np.array([t for t in through(line, self.q) if t != tile and t < there], dtype=int), cosine).any()]
        return self.known[tile]


def jitter(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(float) * (1e-9 / (1 << 24))


# -- dealing -------------------------------------------------------------------------------------


def tiling_of(classes: DataFrame, dims: int, kind: str, n: int, task_bytes: int) -> Tiling:
    """Axes from a bounded sample; cuts from quantiles; boxes as one row for each tile."""
    few = classes.orderBy(F.xxhash64("x")).limit(AXES_SAMPLE).select("x").toArrow()
    u = unit(matrix(few["x"], dims, kind))
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()
    q = order_for(n * dims * np.dtype(kind).itemsize, task_bytes)
    tiles = q * q + q + 1
    slices = math.isqrt(tiles)
    parts = [tiles // slices + (k < tiles % slices) for k in range(slices)]
    flat = Tiling(axes, q, np.zeros(0), [np.zeros(0)])
    width = min(COORDINATES, dims)

    def turned(batches):
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                c = flat.coordinates(matrix(b.column(1), dims, kind))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c[:, k] + (jitter(ids) if k < 2 else 0)) for k in range(width))], ["node", *(f"c{k}" for k in range(width))])

    coordinates = stored(classes.select("node", "x").mapInArrow(turned, "node long, " + ", ".join(f"c{k} double" for k in range(width))), "coordinates")
    edges = np.cumsum(parts)[:-1] / tiles
    cuts = np.array(coordinates.stat.approxQuantile("c0", edges.tolist(), 0.1 / tiles))
    second = "c1" if width > 1 else "c0"
    outer = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>"), lambda c: c < F.col("c0"))) if len(cuts) else F.lit(0)
    most = max(parts)
    found = {r["k"]: r["e"] for r in coordinates.groupBy(outer.alias("k")).agg(F.percentile_approx(second, F.array(*(F.lit(i / 1000) for i in range(1, 1000))), 20 * most).alias("e")).collect()}  # a row for each slice
    inner = [np.array([found[k][min(998, round(1000 * i / m) - 1)] for i in range(1, m)] if k in found else [float("inf")] * (m - 1)) for k, m in enumerate(parts)]
    out = Tiling(axes, q, cuts, inner)

    def boxes(batches):
        for b in batches:
            if b.num_rows:
                c = np.column_stack([b.column(1 + k).to_numpy() for k in range(width)])
                at = out.tiles(c, np.zeros(len(c), dtype=np.int64))  # coordinates have their jitter here
                for t in np.unique(at):
                    rows = c[at == t]
                    yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([rows.min(axis=0).tolist()]), pa.array([rows.max(axis=0).tolist()])], ["tile", "low", "high"])

    box = coordinates.mapInArrow(boxes, "tile long, low array<double>, high array<double>")
    box = box.groupBy("tile").agg(*(f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(width)))
    out.low, out.high = np.full((tiles, width), np.inf), np.full((tiles, width), -np.inf)
    for r in box.collect():  # a row for each tile
        out.low[r["tile"]] = [r[f"low{k}"] for k in range(width)]
        out.high[r["tile"]] = [r[f"high{k}"] for k in range(width)]
    return out


def compared(classes: DataFrame, kind: str, cosine: float, tile: int, task_bytes: int) -> DataFrame:
    """(a, b, links) of classes (node, members, dims, x): links of a over all members of other
    classes where b is null, and else the links of a spanning forest, from each task."""
    spark = classes.sparkSession
    counts = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().collect()}  # a row for each length of vectors
    table = spark.sparkContext.broadcast({d: tiling_of(classes.filter(F.col("dims") == d), d, kind, n, task_bytes) for d, n in counts.items() if n > tile})  # grows with the tiles

    def dealt(batches):
        tilings = table.value
        for b in batches:
            if not b.num_rows:
                continue
            dims = b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                t = b.take(pa.array(np.flatnonzero(dims == d)))
                if (of := tilings.get(d)) is None:
                    at, lines, rows = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64), np.arange(len(t))
                else:
                    ids = t.column(0).to_numpy()
                    at = of.tiles(of.coordinates(matrix(t.column(3), d, kind)), ids)
                    each = [of.tasks(k, cosine) for k in at.tolist()]
                    rows, lines = np.repeat(np.arange(len(t)), [len(x) for x in each]), np.array(list(itertools.chain.from_iterable(each)), dtype=np.int64)
                t = t.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(at[rows]), *t.columns], ["line", "tile", "node", "members", "dims", "x"])

    copies = classes.select("node", "members", "dims", "x").mapInArrow(dealt, "line long, tile long, node long, members long, dims int, x binary")

    def compare(group: pa.Table) -> pa.Table:
        d, line = group["dims"][0].as_py(), group["line"][0].as_py()
        of = table.value.get(d)
        tile, ids, members = (group[c].to_numpy() for c in ("tile", "node", "members"))
        x = matrix(group["x"], d, kind)
        if of is None:
            u = unit(x) if len(x) > d else None
            axes = None if u is None else np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()
        else:
            axes = of.axes
        at = {int(t): np.flatnonzero(tile == t) for t in np.unique(tile)}
        sides, found = {t: Tile(x[rows], axes) for t, rows in at.items()}, []
        for a, b in itertools.combinations_with_replacement(sorted(at), 2):
            if of is None or (home(a, of.q) == line if a == b else of.near(a, np.array([b]), cosine)[0]):
                p = linked(sides[a], sides[b], cosine)
                found.append(np.column_stack([at[a][p[:, 0]], at[b][p[:, 1]]]))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        left, right = pairs[:, 0], pairs[:, 1]
        n = np.bincount(left, members[right], minlength=len(ids)) + np.bincount(right, members[left], minlength=len(ids))
        has = np.flatnonzero(n)
        top = roots(len(ids), pairs)
        edge = np.flatnonzero(top != np.arange(len(ids)))
        return pa.table([pa.array(np.concatenate([ids[has], ids[edge]]), pa.int64()), pa.array([None] * len(has) + ids[top[edge]].tolist(), pa.int64()), pa.array(n[has].astype(int).tolist() + [None] * len(edge), pa.int64())], ["a", "b", "links"])

    return copies.groupBy("dims", "line").applyInArrow(compare, "a long, b long, links long")


# -- the operator ----------------------------------------------------------------------------------


def signed(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(key, class, dims, x): a hash of the vector's bytes, which equal vectors share, its
    length and bytes; nulls for rows that link with nothing."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys, lists = b.column(0), b.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            classes, xs = [None] * len(b), [None] * len(b)
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero((size == d) & known)
                m = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d) + np.zeros(1, kind)  # -0.0 and 0.0 alike; nulls are NaN
                for i in np.flatnonzero(np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)).tolist():
                    xs[at[i]] = m[i].tobytes()
                    classes[at[i]] = xxhash.xxh3_128_digest(xs[at[i]])
            dims = [int(n) if x is not None else None for n, x in zip(size, xs)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(classes, pa.binary()), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())], ["key", "class", "dims", "x"])

    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"
    slim = table_columns(vectors, {"key": F.col(key).cast("long"), "v": F.col(vector) if narrow else F.col(vector).cast("array<double>")})
    return slim.mapInArrow(run, "key long, class binary, dims int, x binary")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, tile: int = TILE, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(key, n_links, component_id, kept) for every row; keys are integers.

    Rows link when their vectors are of one length and their cosine in double precision is at
    least `cosine`; component_id is the smallest key reachable by links. Vectors that are
    null, empty, zero, or that hold null or non-finite components link with nothing, nor do
    rows with a null key; finite components of any size are compared. A repeated row links
    with its copies; different vectors of one key are vectors of their own. An empty table
    gives no rows, and other columns don't matter.
    """
    ready(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    rows = stored(signed(vectors, key, vector, kind).select("key", "class"), "vectors")
    classes = signed(vectors, key, vector, kind).filter("class is not null").groupBy("class").agg(F.min("key").alias("id"), F.count("*").alias("members"), F.first("dims").alias("dims"), F.first("x").alias("x"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = stored(compared(classes, kind, cosine, tile, task_bytes), "links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    reached = components(found.filter("b is not null").select("a", "b"), "a", "b")
    names = classes.select("class", "id", "members", F.col("node").alias("own"))
    told = names.join(links, F.col("own") == F.col("a"), "left").join(reached, F.col("own") == F.col("node"), "left")
    told = told.select(F.col("class").alias("of"), "id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.col("component").alias("group")).filter("n > 0")
    least = told.filter("group is not null").groupBy(F.col("group").alias("g")).agg(F.min("id").alias("least"))
    told = told.join(least, F.col("group") == F.col("g"), "left").select("of", "n", F.coalesce("least", "id").alias("component"))
    told = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a class may hold many of the rows
    dealt = rows.select("key", "class", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    out = dealt.join(told, (dealt["class"] == told["of"]) & (dealt["salt"] == told["part"]), "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
