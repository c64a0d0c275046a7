"""N-gram Jaccard join by chosen paths.

Documents with the same set of word shingles are one class. Each class has a signature of
minimum hashes. A run chooses a few coordinates; classes that agree in a chosen coordinate
share a path. Small buckets of a path are compared by brute force; large ones choose further
coordinates, each with probability 1 / (similarity * HASHES), until they are small or DEPTH
is reached, where they are compared in tiles. Runs are as many as the target recall needs
for a pair that is just similar enough in the deepest buckets.

Brute force over signatures only has to connect what belongs together: it gives a spanning
forest of pairs that look similar, with a margin. Within each of its components the sets
themselves are compared: all links between classes are counted by exact Jaccard similarity,
and their spanning forest gives the classes of near-copies. No step lists all pairs of a
group.

A group that is too large for one box, by its members or by the bytes of their sets, is dealt
into tiles, which are the points of a projective plane and boxes its lines: any two tiles
meet in one box, and a member is copied about as often as the root of the number of tiles.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import components, each_table, gathered, home, order_for, ready, roots, table_columns, through
from caselens.session import stored

WORDS = 5
SIMILARITY = 0.8
#: Coordinates of a signature.
HASHES = 64
#: Levels of chosen coordinates, and the share of just-similar pairs to be found.
DEPTH = 3
RECALL = 0.999
#: Classes of a bucket that are compared at once; larger buckets split.
SMALL = 256
#: Sets in a box, and their bytes; signatures in a box.
BOX = 512
BOX_BYTES = 32 << 20
SIGNATURES = 4096
#: Agreeing coordinates from which a pair of signatures is looked at exactly: the similarity
#: less four standard deviations of the estimate.
MARGIN = 4.0
#: Parts that a class's rows are dealt into.
SALTS = 32
#: Distinct words that a worker remembers.
REMEMBERED = 200_000

_mask = (1 << 64) - 1
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
STEPS = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles; words are runs without the white space of op2's rules."""

    table = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes. Fewer words than WORDS are one shingle; none, an empty set."""
        words = [w for w in text.translate(self.table).split(" ") if w]
        known = self.known
        if new := set(words).difference(known):
            if len(known) > REMEMBERED:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(WORDS, len(h))
        if not n:
            return h
        with np.errstate(over="ignore"):
            total = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                total = mixed(total + h[i : len(h) - n + 1 + i] * STEPS[i])
        return np.unique(total)


@functools.cache
def shingler() -> Shingler:
    return Shingler()


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            v = (s[i : i + 4096, None] * FACTORS + TERMS) >> np.uint64(32)
            out = np.minimum(out, v.min(axis=0).astype(np.uint32))
    return out


def runs_needed(similarity: float, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs after which a pair of that similarity has met in a deepest bucket with the given
    probability. Coordinates that both choose and agree in are Poisson with mean 1 at each
    level, so it survives d levels with q(d) = 1 - exp(-q(d - 1)), q(0) = 1."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


# -- chosen paths ------------------------------------------------------------------------------


def first_paths(classes: DataFrame, similarity: float) -> DataFrame:
    """(path, id): each class's paths after the first level of all runs. Runs choose
    different coordinates while there are any."""
    rng = np.random.default_rng(5)
    chosen = []
    runs, left = runs_needed(similarity), list(rng.permutation(HASHES))
    for run in range(runs):
        k = math.floor((run + 1) / similarity) - math.floor(run / similarity)
        for _ in range(k):
            if not left:
                left = list(rng.permutation(HASHES))
            chosen.append((run, left.pop()))
    run_of, at = np.array([r for r, _ in chosen], dtype=np.uint64), np.array([c for _, c in chosen])

    def run(t: pa.Table) -> pa.Table:
        sig = _signatures(t["sig"])
        path = mixed(mixed(run_of * np.uint64(1 << 20) + at.astype(np.uint64))[None, :] + sig[:, at].astype(np.uint64))
        ids = np.repeat(t["id"].to_numpy(), len(at))
        return pa.table([pa.array(path.reshape(-1).view(np.int64)), pa.array(ids)], ["path", "id"])

    return classes.select("id", "sig").mapInArrow(each_table(run, 4 << 20), "path long, id long")


def further_paths(members: DataFrame, similarity: float) -> DataFrame:
    """(path, id) a level below (path, id, sig): the path alone says which coordinates are
    chosen, so all of a bucket choose the same."""
    limit = np.uint64(int(_mask / (similarity * HASHES)))

    def run(t: pa.Table) -> pa.Table:
        sig, node, ids = _signatures(t["sig"]), t["path"].to_numpy().view(np.uint64), t["id"].to_numpy()
        parts = []
        for i in range(0, len(ids), 8192):
            draw = mixed(mixed(node[i : i + 8192])[:, None] + np.arange(1, HASHES + 1, dtype=np.uint64)[None, :])
            row, at = np.nonzero(draw < limit)
            path = mixed(draw[row, at] + sig[i + row, at].astype(np.uint64))
            parts.append((path.view(np.int64), ids[i + row]))
        return pa.table([pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)) for k in (0, 1)], ["path", "id"])

    return members.select("path", "id", "sig").mapInArrow(each_table(run, 4 << 20), "path long, id long")


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def shared_buckets(paths: DataFrame, last: bool) -> DataFrame:
    """(path, id, n): the members of paths that two classes or more share. Of buckets with
    the same members one is kept where they are compared; those that still have to split all
    stay, as each draws coordinates of its own, or none. Buckets are counted before members
    meet them."""
    paths = stored(paths, "paths")
    sizes = paths.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).filter("n > 1")
    splits = F.lit(None).cast("long") if last else F.when(F.col("n") > SMALL, F.col("path"))
    kept = sizes.groupBy("members", "n", splits.alias("splits")).agg(F.min("path").alias("bucket")).select("bucket", "n")
    kept = stored(kept, "buckets")
    return stored(paths.join(kept, F.col("path") == F.col("bucket")).select("path", "id", "n"), "members")


def candidate_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs whose signatures look similar, per bucket."""
    sig = classes.select(F.col("id").alias("of"), "sig")
    least = math.ceil(HASHES * (similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / HASHES)))
    found, paths = None, first_paths(classes, similarity)
    for level in range(1, DEPTH + 1):
        last = level == DEPTH
        members = shared_buckets(paths, last)
        leaves = members if last else members.filter(F.col("n") <= SMALL)
        pairs = stored(_similar(leaves.join(sig, F.col("id") == F.col("of")), least, last), "candidates")
        found = pairs if found is None else found.unionByName(pairs)
        if last or (large := members.filter(F.col("n") > SMALL)).isEmpty():
            break
        paths = further_paths(large.join(sig, F.col("id") == F.col("of")), similarity)
    return found


def places(member: int, q: int) -> list[tuple[int, int, bool]]:
    """(box, tile, whether the tile is compared with itself there) of a member, by its id; all
    are in one box where q is 0."""
    if not q:
        return [(0, 0, True)]
    tile = int(mixed(np.array([member], dtype=np.int64).view(np.uint64))[0] % np.uint64(q * q + q + 1))
    return [(line, tile, line == home(tile, q)) for line in through(tile, q)]


def _similar(leaves: DataFrame, least: int, last: bool) -> DataFrame:
    """A spanning forest of the pairs of (path, id, n, sig) that agree in `least` coordinates,
    from each box. Only at the last level may a bucket be too large for one."""
    one = leaves.filter(F.col("n") <= SIGNATURES) if last else leaves
    boxes = one.select("path", F.lit(0).cast("long").alias("box"), F.struct(F.lit(0).cast("long").alias("tile"), F.lit(True).alias("home"), "id", "sig").alias("m"))
    if last:

        def dealt(batches):
            for t in gathered(batches, 1 << 20):
                at = [places(i, order_for(n, SIGNATURES)) for i, n in zip(t["id"].to_pylist(), t["n"].to_pylist())]
                rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
                for s in range(0, len(rows), 20_000):
                    part, where = rows[s : s + 20_000], [x for r in at for x in r][s : s + 20_000]
                    u = t.take(pa.array(part))
                    yield from pa.table([u["path"], pa.array([x[0] for x in where], pa.int64()), pa.array([x[1] for x in where], pa.int64()), pa.array([x[2] for x in where]), u["id"], u["sig"]], ["path", "box", "tile", "home", "id", "sig"]).to_batches()

        many = leaves.filter(F.col("n") > SIGNATURES).select("path", "id", "n", "sig").mapInArrow(dealt, "path long, box long, tile long, home boolean, id long, sig binary")
        boxes = boxes.unionByName(many.select("path", "box", F.struct("tile", "home", "id", "sig").alias("m")))
    boxes = boxes.groupBy("path", "box").agg(F.collect_list("m").alias("m"))  # SIGNATURES at most, about

    def compare(batches):
        for t in gathered(batches, 4 << 20):
            out = []
            for tile, own, ids, (sig,) in _boxes(t, ("sig",)):
                s = np.frombuffer(b"".join(sig), "<u4").reshape(-1, HASHES)
                pairs = []
                for i in range(0, len(ids), 64):
                    x, y = np.nonzero((s[i : i + 64, None, :] == s[None, i:, :]).sum(axis=2) >= least)
                    x, y = x + i, y + i
                    pairs.append(np.column_stack([x, y])[(x < y) & (ids[x] != ids[y]) & (own[x] | (tile[x] != tile[y]))])
                top = roots(len(ids), np.concatenate(pairs))
                at = np.flatnonzero(top != np.arange(len(ids)))
                out.append(np.column_stack([ids[at], ids[top[at]]]))
            rows = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])

    return boxes.mapInArrow(compare, "a long, b long")


def _boxes(t: pa.Table, more: tuple[str, ...]):
    """Each row's members, from a column m of structs: tiles, homes, ids and more."""
    for chunk in t.to_batches():
        m = chunk.column("m")
        flat, offsets = m.flatten(), m.offsets.to_numpy()
        offsets = offsets - offsets[0]
        tile, ids, own = flat.field("tile").to_numpy(), flat.field("id").to_numpy(), flat.field("home").to_numpy(zero_copy_only=False)
        rest = [flat.field(c) for c in more]
        for k in range(len(chunk)):
            s = slice(offsets[k], offsets[k + 1])
            yield tile[s], own[s], ids[s], [c.slice(s.start, s.stop - s.start).to_pylist() for c in rest]


# -- exact links -------------------------------------------------------------------------------


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of left with right sets. Shingles that stand in the same
    sets are one weighted column, so groups of near-copies need few columns."""
    if len(sets) == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        sizes = np.array([[len(sets[0]), both], [both, len(sets[1])]])
        return sizes[np.ix_(left, right)]
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    doc = np.repeat(np.arange(len(sets)), size)[order]
    values = values[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    times = np.diff(np.append(starts, len(values)))
    marks = mixed(np.arange(1, len(sets) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        pattern = np.add.reduceat(marks[doc], starts) if len(starts) else np.zeros(0, np.uint64)
    many = np.flatnonzero(times > 1)
    _, first, weight = np.unique(pattern[many], return_index=True, return_counts=True)
    kept = many[first]
    total = np.zeros((len(left), len(right)))
    for i in range(0, len(kept), columns):
        part = kept[i : i + columns]
        n = times[part]
        at = np.repeat(starts[part] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        x = np.zeros((len(sets), len(part)), dtype=np.float32)
        x[doc[at], np.repeat(np.arange(len(part)), n)] = 1
        total += (x[left] * weight[i : i + columns].astype(np.float32)) @ x[right].T
    return np.rint(total).astype(np.int64)


def box_order(n: int, size: int) -> int:
    """The plane of a group of n sets of so many bytes: 0 where one box holds it."""
    return max(order_for(n, BOX), order_for(size, BOX_BYTES)) if n > BOX or size > BOX_BYTES else 0


def exact_links(docs: DataFrame, grouped: DataFrame, similarity: float, repeated: bool) -> DataFrame:
    """(a, b, links) within groups of (id, group, n, bytes, members, class): links of a over
    the members of other classes where b is null, and else a spanning forest of links.

    repeated: whether rows of docs may be alike; then each is compared once.
    """

    def sets(batches):
        names = ["id", "group", "members", "box", "tile", "home", "set"]
        for t in gathered(batches, 4 << 20):
            held, size = [], 0
            for i, g, n, b, members, c, text in zip(*(t[k].to_pylist() for k in ("id", "group", "n", "bytes", "members", "class", "text"))):
                s = shingler().of(text)
                if class_of(s) != c:  # another text of this key is not meant
                    continue
                own = s.tobytes()
                for box, tile, at_home in places(i, box_order(n, b)):
                    held.append((i, g, members, box, tile, at_home, own))
                    size += len(own) + 64
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names)

    texts = docs.join(grouped, docs["key"] == grouped["id"]).select("id", "group", "n", "bytes", "members", "class", "text")
    if repeated:
        texts = texts.groupBy("id", F.xxhash64("text").alias("h")).agg(*(F.first(c).alias(c) for c in texts.columns[1:])).drop("h")
    boxes = texts.mapInArrow(sets, "id long, group long, members long, box long, tile long, home boolean, set binary")
    boxes = boxes.groupBy("group", "box").agg(F.collect_list(F.struct("tile", "home", "id", "members", "set")).alias("m"))  # BOX sets and BOX_BYTES, about

    def compare(batches):
        for t in gathered(batches, 16 << 20):
            count, forest = [], []
            for tile, own_box, ids, (members, raw) in _boxes(t, ("members", "set")):
                if len(ids) < 2:
                    continue
                members, own = np.array(members), [np.frombuffer(x, np.uint64) for x in raw]
                size = np.array([len(s) for s in own])
                every = np.arange(len(ids))
                shared = intersections(own, every, every)
                union = size[:, None] + size[None, :] - shared
                x, y = np.nonzero(shared >= similarity * union - 1e-9)
                keep = (x < y) & (own_box[x] | (tile[x] != tile[y]))
                x, y = x[keep], y[keep]
                links = np.bincount(x, members[y], minlength=len(ids)) + np.bincount(y, members[x], minlength=len(ids))
                top = roots(len(ids), np.column_stack([x, y]))
                has, at = np.flatnonzero(links), np.flatnonzero(top != every)
                count.append(np.column_stack([ids[has], links[has].astype(np.int64)]))
                forest.append(np.column_stack([ids[at], ids[top[at]]]))
            c = np.concatenate(count) if count else np.zeros((0, 2), np.int64)
            f = np.concatenate(forest) if forest else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[:, 0], f[:, 0]])), pa.array([None] * len(c) + f[:, 1].tolist(), pa.int64()), pa.array(c[:, 1].tolist() + [None] * len(f), pa.int64())], ["a", "b", "links"])

    return boxes.mapInArrow(compare, "a long, b long, links long")


def class_of(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


# -- the operator ------------------------------------------------------------------------------


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, n_links) for every row; keys are integers and tell texts apart.

    n_links: other rows whose shingle sets have a Jaccard similarity of at least
    `similarity`, copies included; class_id: the smallest key reachable by links. Texts that
    are null or hold no words link with nothing, nor do rows with a null key. Repeated rows
    link with each other. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    slim = table_columns(docs, {"key": F.col(key).cast("long"), "text": F.coalesce(F.col(text), F.lit(""))})

    def sign(t: pa.Table) -> pa.Table:
        sets = [shingler().of(x) for x in t["text"].to_pylist()]
        sigs = [signature(s).tobytes() if len(s) else None for s in sets]
        return pa.table([t["key"], pa.array(map(class_of, sets), pa.binary()), pa.array(sigs, pa.binary()), pa.array([s.nbytes for s in sets], pa.int64())], ["key", "class", "sig", "bytes"])

    rows = stored(slim.mapInArrow(each_table(sign), "key long, class binary, sig binary, bytes long"), "signed")
    classes = rows.filter("class is not null and key is not null").groupBy("class").agg(F.min("key").alias("id"), F.count("*").alias("members"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes"))
    classes = stored(classes, "classes")
    groups = components(candidate_pairs(classes, similarity), "a", "b")
    groups = stored(groups.select(F.col("node").alias("of"), F.col("component").alias("group")), "groups")
    named = groups.join(classes.select("id", "class", "members", F.col("bytes").alias("own")), F.col("of") == F.col("id"))
    sizes = named.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("n"), F.sum("own").alias("bytes"))
    grouped = named.join(sizes, F.col("group") == F.col("g")).select("id", "group", "n", "bytes", "members", "class")
    repeated = not rows.filter("key is not null").groupBy("key").count().filter("count > 1").isEmpty()
    found = stored(exact_links(slim, grouped, similarity, repeated), "links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    reached = components(found.filter("b is not null").select("a", "b"), "a", "b")
    told = classes.select(F.col("class").alias("of"), "id", "members").join(links, F.col("id") == F.col("a"), "left").join(reached, F.col("id") == F.col("node"), "left")
    told = told.select("of", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component")).filter("n > 0")
    told = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a class may hold many of the rows
    dealt = rows.select("key", F.when(F.col("key").isNotNull(), F.col("class")).alias("class"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    out = dealt.join(told, (dealt["class"] == told["of"]) & (dealt["salt"] == told["part"]), "left")
    return out.select(F.col("key").alias(key), F.coalesce("component", "key").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that are near-copies of a document with a smaller doc_id: one row of
    each class stays, of repeated rows too. Rows with a null key stay. Texts of one doc_id
    that differ count as documents of their own."""
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        gone = joined(docs, similarity=similarity).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone"))
        return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    marked = docs.withColumn("_mark", F.coalesce(F.md5("text"), F.lit("")))
    keys = marked.filter("doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_of")).distinct().orderBy("_id", "_of")
    keys = stored(keys.withColumn("_key", F.monotonically_increasing_id()), "keys")  # in the order of doc_id
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_mark") == F.col("_of"))
    texts = stored(marked.join(keys, same).select("_key", "text"), "texts")
    gone = joined(texts, "_key", similarity=similarity).filter("_key <> class_id").select("_key").distinct()
    kept = marked.join(keys.join(gone, "_key", "left_semi"), same, "left_anti")
    return kept.filter("doc_id is null").unionByName(kept.filter("doc_id is not null").dropDuplicates(["doc_id", "_mark"])).select(*docs.columns)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
