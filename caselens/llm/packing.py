"""Best-fit packing by a linear grouping scheme.

Sequences hold at most `capacity` tokens. The lengths' histogram, bounded by the capacity
whatever the input, comes to the driver. There:

1. large lengths are sorted and dealt into groups of equal cardinality; each group's lengths
   are rounded up to its longest;
2. configurations of the few rounded sizes are optimised as a linear program by column
   generation (a knapsack prices new configurations). The small lengths take part as one
   more row, their volume: a configuration's room counts for as much of it as the lengths
   that fit into that room hold, so that configurations leave no room, or room of use;
3. the program's whole part is taken, and actual lengths are substituted for the rounded
   ones, longest first; the slack that opens lets later slots take longer ones. The tightest
   configurations are accepted; the other documents are grouped anew and solved again, until
   no whole configuration comes out;
4. what is left then goes best-fit into the slack or into new sequences, and after it the
   small lengths, longest first.

The plan names, for each length, which ranks of that length go where. Documents get a rank
within their length and find their place by binary search in the plan, in parallel.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselens.llm.common import each_table, ready, table_columns
from caselens.session import stored

CAPACITY = 2048
#: Linear groupings that are tried: the share of the capacity from which a length is large,
#: and the number of groups. A low share suits data with few small lengths.
SCHEMES = ((2 / 5, 64), (1 / 8, 32))
#: Groups times capacity up to which more groups cost nothing worth speaking of.
WORK = 1 << 16
#: Waste up to which configurations are accepted, by round; then any.
WASTE = (0, 1, 2, 4, 8, 16, 32)
#: Pieces of one length that are ranked in one task.
RANKED = 20_000
#: Distinct pieces of text that a worker remembers.
REMEMBERED = 200_000


# -- tokens ---------------------------------------------------------------------------------


class WordTokens:
    """Ids from a tokenizers file that lowers case, drops white space and ends words: each
    distinct run without blanks and line ends is encoded once and remembered. Runs of plain
    letters and then marks go to the library's merges directly; the library's whole chain
    takes all others."""

    #: Letters that lower to one letter of the same range and are stable under NFC, then marks.
    plain = re.compile(r"([A-Za-zÀ-ÖØ-Þà-öø-ÿ]*)([.,;:!?|*#$%&]*)").fullmatch

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level names of bytes: themselves, or from 256 on
        rest = [b for b in range(256) if b not in shown]
        self.names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _part(self, s: str) -> bytes:
        if (ids := self.parts.get(s)) is None:
            name = s if s.isascii() else "".join(map(self.names.__getitem__, s.encode()))
            ids = self.parts[s] = np.array([t.id for t in self.merges(name)], dtype="<u4").tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text, without special tokens."""
        words = text.replace("\n", " ").split(" ")
        known = self.known
        if new := set(words).difference(known):
            if len(known) > REMEMBERED:
                known.clear()
                self.parts = {"": b""}
                new = set(words)
            odd = []
            for w in new:
                if m := self.plain(w):
                    known[w] = self._part(m[1].lower()) + self._part(m[2])
                else:
                    odd.append(w)
            for w, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False)):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
        return b"".join(map(known.__getitem__, words))


@functools.cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, key: str = "doc_id", text: str | Column = "text", path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids): each text's ids and then end_id, cut into pieces of
    capacity where they are more; ids as little-endian unsigned 32-bit integers.

    A null or empty text is one piece that holds end_id alone. Repeated rows and null keys
    each give their pieces; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    text = F.col(text) if isinstance(text, str) else text
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(t: pa.Table) -> pa.Table:
        of, out = word_tokens(path), ([], [], [], [], [])
        for k, x in zip(t["key"].to_pylist(), t["text"].to_pylist()):
            ids = of.ids(x) + end
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for column, v in zip(out, (k, n, at // 4, len(part) // 4, part)):
                    column.append(v)
        return pa.table([pa.array(c, kind) for c, kind in zip(out, (t["key"].type, pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["key", "piece", "start", "length", "ids"])

    slim = table_columns(docs, {"key": F.col(key), "text": F.coalesce(text, F.lit(""))})
    return slim.mapInArrow(each_table(run, 8 << 20), f"key {slim.schema['key'].dataType.simpleString()}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


# -- the plan, on the driver, from the histogram alone ---------------------------------------


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int, room_worth: np.ndarray) -> tuple[float, list[int], int]:
    """(worth, counts, room) of the multiset of sizes within the capacity that is worth most
    together with the room it leaves; room_worth: by room."""
    worth = np.full(capacity + 1, -np.inf)  # of sizes that sum up to exactly so much
    worth[0] = 0
    took = []
    for s, v in zip(sizes.tolist(), values.tolist()):
        for _ in range(capacity // s if v > 1e-12 else 0):
            other = worth[: capacity + 1 - s] + v
            better = other > worth[s:] + 1e-12
            if not better.any():
                break
            mask = np.zeros(capacity + 1, dtype=bool)
            mask[s:] = better
            worth[s:][better] = other[better]
            took.append((s, mask))
    whole = worth + room_worth[::-1]
    at = int(np.argmax(whole))
    total, room, counts, places = float(whole[at]), capacity - at, [0] * len(sizes), {int(s): i for i, s in enumerate(sizes)}
    for s, mask in reversed(took):
        if mask[at]:
            counts[places[s]] += 1
            at -= s
    return total, counts, room


def useful_room(small: list[tuple[int, int]], capacity: int) -> np.ndarray:
    """By room, how much of it small lengths can be taken to fill: the room times their
    volume's share that fits into it."""
    volume = np.zeros(capacity + 1)
    for length, n in small:
        volume[length] += length * n
    share = np.cumsum(volume) / volume.sum() if volume.any() else volume
    return share * np.arange(capacity + 1)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, small: float = 0.0, useful: np.ndarray | None = None, rounds: int = 3000) -> list[tuple[int, list[int], float]]:
    """(times, counts of each size, volume left for small lengths): the linear program that
    covers the sizes' demand and the small volume by the fewest sequences, solved by column
    generation with a revised simplex; its whole part."""
    useful = np.zeros(capacity + 1) if useful is None else useful
    k = len(sizes)
    basis = np.diag(np.append(capacity // sizes, capacity)).astype(float)  # columns: one size alone, and small lengths alone
    inverse = np.linalg.inv(basis)
    x = inverse @ np.append(demand, small)
    for step in range(rounds):
        prices = np.maximum(inverse.sum(axis=0), 0)  # every configuration costs one sequence
        worth, counts, room = best_configuration(sizes, prices[:k], capacity, prices[k] * useful)
        if worth <= 1 + 1e-7:
            break
        column = np.array([*counts, useful[room] if prices[k] > 0 else 0.0])
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        x[x < 1e-9] = 0
        basis[:, out] = column
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
    return [(int(n + 1e-6), basis[:k, i].astype(int).tolist(), float(basis[k, i])) for i, n in enumerate(x) if n + 1e-6 >= 1 and basis[:k, i].any()]


class Slack:
    """Sequences that are alike, as [times, lengths], found by what room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, {}, []

    def add(self, times: int, lengths: tuple[int, ...]) -> None:
        if times:
            room = self.capacity - sum(lengths)
            if room not in self.by_room:
                self.by_room[room] = []
                bisect.insort(self.rooms, room)
            self.by_room[room].append((times, lengths))

    def best_fit(self, length: int, count: int) -> None:
        """count items of one length, each into the least room that takes it."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            room = self.rooms[at] if at < len(self.rooms) else None
            if room is None:
                each = self.capacity // length
                self.add(count // each, (length,) * each)
                self.add(1 if count % each else 0, (length,) * (count % each))
                return
            times, lengths = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.pop(at)
            each = room // length
            used = min(times, count // each)
            self.add(used, lengths + (length,) * each)
            count -= used * each
            times -= used
            if times and count:  # fewer are left than fill one
                self.add(1, lengths + (length,) * count)
                count, times = 0, times - 1
            self.add(times, lengths)

    def all(self) -> list[tuple[int, tuple[int, ...]]]:
        return [x for room in self.by_room.values() for x in room]


def grouped(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) pairs, longest first, dealt into groups of equal cardinality. All of
    a length may lie in more than one group."""
    total = sum(n for _, n in counts)
    edges = [round(total * (i + 1) / groups) for i in range(groups)]
    out, seen, g = [[] for _ in range(groups)], 0, 0
    for length, n in counts:
        while n:
            while seen >= edges[g]:
                g += 1
            take = min(n, edges[g] - seen)
            out[g].append((length, take))
            seen, n = seen + take, n - take
    return [x for x in out if x]


class Lengths:
    """Counts of lengths, found by the longest that is not over a limit."""

    def __init__(self, counts: Counter):
        self.counts, self.lengths = counts, sorted(counts)

    def take(self, limit: int, most: int) -> tuple[int, int]:
        """(length, how many of it are taken): of the longest length up to the limit; (0, 0)
        where there is none."""
        at = bisect.bisect_right(self.lengths, limit) - 1
        if at < 0:
            return 0, 0
        length = self.lengths[at]
        n = min(most, self.counts[length])
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(at)
        return length, n


def configured(left: Counter, volume: float, useful: np.ndarray, capacity: int, groups: int) -> list[tuple[int, tuple[int, ...], int, float]]:
    """(times, lengths, waste, volume) of whole configurations of the large lengths; `left`
    keeps the others. waste: room beyond what the configuration leaves for small lengths;
    volume: how much of the small lengths' volume it leaves room for.

    A slot of a configuration takes the longest length that is left and leaves enough for the
    slots after it, as rounded, and for the small ones: what rounding opens goes to longer
    documents than planned, so that what is left only becomes easier to place.
    """
    merged = Counter()
    for group in grouped(sorted(left.items(), reverse=True), groups):  # groups with the same longest length are one size
        merged[group[0][0]] += sum(n for _, n in group)
    sizes = sorted(merged)
    made = configurations(np.array(sizes), np.array([merged[s] for s in sizes], dtype=float), capacity, volume, useful)
    slots = [([s for s, n in zip(reversed(sizes), reversed(config)) for _ in range(n)], times, v) for times, config, v in made]
    out, lengths = [], Lengths(left)
    for planned, times, v in sorted(slots, reverse=True):
        alike = [(times, (), 0 if v else capacity - sum(planned))]  # all room is for small lengths, or none of it
        for size in planned:
            parts = []
            for m, held, spare in alike:
                while m:
                    length, n = lengths.take(size + spare, m)
                    if not n:
                        parts.append((m, held, spare + size))
                        break
                    parts.append((n, (*held, length), spare + size - length))
                    m -= n
            alike = parts
        out += [(m, held, spare, v) for m, held, spare in alike if held]
    return out


def grouping(histogram: dict[int, int], capacity: int, groups: int, large: float) -> tuple[list[tuple[int, tuple[int, ...]]], Counter]:
    """(times, lengths) of the configurations that the linear grouping of the lengths over
    large x capacity comes to, and what it leaves of these lengths.

    Rounds accept configurations of ever more waste, the tightest first; documents of the
    others are grouped and solved again.
    """
    small = [(length, n) for length, n in histogram.items() if length <= large * capacity and length < capacity]
    left = Counter({length: n for length, n in histogram.items() if large * capacity < length < capacity and n > 0})
    volume, useful = float(sum(length * n for length, n in small)), useful_room(small, capacity)
    groups = max(groups, WORK // capacity)
    out = []
    for most in (*WASTE, capacity):
        while left:
            made = configured(left, volume, useful, capacity, groups)
            good = [x for x in made if x[2] <= most]
            for times, held, waste, _ in made:
                for length in held if waste > most else ():
                    left[length] += times
            out += [(times, held) for times, held, _, _ in good]
            volume = max(volume - sum(times * v for times, _, _, v in good), 0.0)
            if most < capacity or not good:
                break
    return out, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, schemes: tuple[tuple[float, int], ...] = SCHEMES) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of the sequences that hold exactly what the histogram counts: the
    scheme of fewest sequences, the first of equal ones. Each scheme, a least share of the
    capacity and a number of groups, is a whole linear grouping."""
    if any(n > 0 and not 1 <= length <= capacity for length, n in histogram.items()):
        raise ValueError("lengths must be between 1 and the capacity")
    best = None
    for large, groups in schemes:
        made, left = grouping(histogram, capacity, groups, large)
        slack = Slack(capacity)
        slack.add(histogram.get(capacity, 0), (capacity,))
        for times, lengths in made:
            slack.add(times, lengths)
        left += Counter({length: n for length, n in histogram.items() if length <= large * capacity and length < capacity and n > 0})
        for length, n in sorted(left.items(), reverse=True):
            slack.best_fit(length, n)
        found = slack.all()
        if best is None or sum(n for n, _ in found) < sum(n for n, _ in best):
            best = found
    return best


def places(sequences: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) by length and first rank: the item
    of that length and rank r goes to sequence first + r - first rank, at offset."""
    rows, used, base = [], Counter(), 0
    for times, lengths in sorted(sequences, key=lambda x: (x[1], x[0]), reverse=True):
        at = 0
        for length in lengths:
            rows.append((length, used[length], base, at))
            used[length] += times
            at += length
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


# -- the operator ----------------------------------------------------------------------------


def ranked(items: DataFrame, length: str, lot: str, most: int) -> DataFrame:
    """items with `rank`, 0.. within each length. A length's items are dealt over many
    buckets by their lot, which no two rows share; buckets are counted, and each item ranked
    in its bucket alone."""
    buckets = max(64, -(-most // RANKED))
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64(lot), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(F.col(length).alias("of"), F.col("bucket").alias("in")).agg(F.count("*").alias("n"))
    before = sizes.select("of", "in", (F.sum("n").over(Window.partitionBy("of").orderBy("in")) - F.col("n")).alias("before"))
    within = dealt.withColumn("within", F.row_number().over(Window.partitionBy(length, "bucket").orderBy(lot)) - 1)
    joined = within.join(before, (within[length] == before["of"]) & (within["bucket"] == before["in"]))
    return joined.withColumn("rank", F.col("before") + F.col("within")).drop("of", "in", "before", "within", "bucket", lot)


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset, gapless from 0 in each sequence.

    Rows that are alike get places of their own, and however many there are, they are ranked
    in many tasks. Null lengths or lengths outside 1..capacity raise an error; an empty table
    gives no rows.
    """
    spark = ready(items.sparkSession)
    items = stored(items.withColumn("_lot", F.monotonically_increasing_id()), "items")
    counts = {r[0]: r[1] for r in items.groupBy(length).agg(F.count("*")).collect()}  # at most `capacity` rows
    if None in counts:
        raise ValueError("a length is null")
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # grows with the capacity, not with the rows
    ranks = ranked(items, length, "_lot", max(counts.values(), default=0))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != "_lot")

    def run(t: pa.Table) -> pa.Table:
        rows = table.value
        size, rank = t[length].to_numpy(), t["rank"].to_numpy()
        at = np.searchsorted((rows[:, 0] << 44) + rows[:, 1], (size.astype(np.int64) << 44) + rank, side="right") - 1
        return t.drop_columns(["rank"]).append_column("sequence_id", pa.array(rows[at, 2] + rank - rows[at, 1])).append_column("offset", pa.array(rows[at, 3]))

    return ranks.mapInArrow(each_table(run), f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces
    with their places. Null and empty texts are one piece of the end id alone; rows with a
    null doc_id and repeated rows are packed each; an empty table gives no rows; other
    columns of docs don't matter. Texts of any length are encoded whole."""
    return pack(pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
