"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the distinct pre-tokens of its documents into one corpus of bytes. An
inverted index leads from the rank of a token pair to the positions where that pair stands;
ranks are replayed from the lowest on, each over all of its positions at once, and only the
neighbours of merged positions are looked up again. Pre-tokens never interact, so a corpus
per task gives what one corpus of all documents would, in bounded memory and without a
shuffle, and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import each_table, ready, table_columns

NONE = np.int64(1) << 40
#: Distinct pieces of text that a worker remembers.
REMEMBERED = 200_000
#: Bytes of text that a task gathers for one replay.
CORPUS_BYTES = 4 << 20
#: A blank between white space: there a run of white space can't be cut before the blank.
_blanks = re.compile(r"\s (?!\S)").search


def _distinct(a: np.ndarray) -> np.ndarray:
    a.sort()
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


class MergeReplay:
    """The ranks of a byte-level BPE, and the replay of its merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = dict(sorted((r, t) for t, r in ranks.items()))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.width = max(self.tokens) + 1
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.pieces: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def one(self, word: bytes) -> bytes:
        """A single pre-token: always the leftmost pair of the lowest rank."""
        tok = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        nxt, prv, look = [*range(1, n), -1], [*range(-1, n - 1)], self.pairs.get
        heap = [(r, p, tok[p], tok[p + 1]) for p in range(n - 1) if (r := look(tok[p] * self.width + tok[p + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, p, a, b = heapq.heappop(heap)
            q = nxt[p]
            if tok[p] != a or q < 0 or tok[q] != b:
                continue
            tok[p], tok[q], nxt[p] = r, -1, nxt[q]
            if nxt[q] >= 0:
                prv[nxt[q]] = p
            for i in (prv[p], p):
                if i >= 0 and nxt[i] >= 0 and (x := look(tok[i] * self.width + tok[nxt[i]])) is not None:
                    heapq.heappush(heap, (x, i, tok[i], tok[nxt[i]]))
        return np.array([t for t in tok if t >= 0], dtype="<u4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        size = np.array([len(w) for w in words], dtype=np.int64)
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n, word, ends = len(tok), np.repeat(np.arange(len(words)), size), np.cumsum(size)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = size > 0
        nxt[ends[full] - 1] = -1
        prv[(ends - size)[full]] = -1
        now = np.full(n, NONE)
        inner = np.flatnonzero(nxt >= 0)
        now[inner] = self.rank_of(tok[inner], tok[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[now[at] < NONE]
            at = at[np.argsort(now[at], kind="stable")]
            ranks = now[at]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part in np.split(at, cuts) if len(at) else ():
                r = int(now[part[0]])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        put(inner)
        odd: set[int] = set()
        live = np.ones(n, dtype=bool)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else _distinct(np.concatenate(lists))
            at = at[now[at] == r]
            if not len(at):
                continue
            right = nxt[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # pairs that overlap: the left one first
                taken, used = [], -1
                for p, q in zip(at.tolist(), right.tolist()):
                    if p != used:
                        taken.append(p)
                        used = q
                at = np.array(taken, dtype=np.int64)
                right = nxt[at]
            tok[at] = r
            live[right] = False
            now[right] = NONE
            after = nxt[right]
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            touched = _distinct(np.concatenate([at, before[before >= 0]]))
            follow = nxt[touched]
            more = follow >= 0
            now[touched[~more]] = NONE
            touched, follow = touched[more], follow[more]
            now[touched] = fresh = self.rank_of(tok[touched], tok[follow])
            if (low := fresh <= r).any():  # a merge opened one of no higher rank: such words go alone
                for w in np.unique(word[touched[low]]).tolist():
                    odd.add(w)
                    now[ends[w] - size[w] : ends[w]] = NONE
            put(touched)
        out = tok[live].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(word[live], minlength=len(words)))).tolist()
        starts = [0, *stops]
        return [self.one(words[i]) if i in odd else out[s:e] for i, (s, e) in enumerate(zip(starts, stops))]

    def encode(self, texts: list[str], pattern: str) -> list[bytes]:
        """Texts are cut before blanks where no pre-token can span the cut, so that the
        pattern runs once over each distinct piece; other texts go to the pattern whole."""
        if pattern != public_tokenizers.PATTERN:
            return self._by_pattern(texts, pattern)
        known, new = self.pieces, set()
        plain = [not _blanks(t) for t in texts]
        for t, ok in zip(texts, plain):
            if ok:
                new.update(set(t.split(" ")[1:]).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            for t, ok in zip(texts, plain):
                if ok:
                    new.update(t.split(" ")[1:])
        new = list(new)
        rest = [t.split(" ", 1)[0] if ok else t for t, ok in zip(texts, plain)]
        found = self._by_pattern([" " + p for p in new] + rest, pattern)
        known.update(zip(new, found))
        look = known.__getitem__
        return [first + b"".join(map(look, t.split(" ")[1:])) if ok else first for t, ok, first in zip(texts, plain, found[len(new) :])]

    def _by_pattern(self, texts: list[str], pattern: str) -> list[bytes]:
        split = _pattern(pattern).findall
        parts = [split(t) for t in texts]
        words = list(dict.fromkeys(itertools.chain.from_iterable(parts)))
        ids = dict(zip(words, self.words([w.encode("utf-8", "surrogatepass") for w in words])))
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def _pattern(pattern: str):
    return regex.compile(pattern)


@functools.cache
def replay(path: str) -> MergeReplay:
    """The replay for a file of base64 tokens and ranks; one for each worker process."""
    with open(path, "rb") as f:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(docs: DataFrame, key: str = "doc_id", text: str | Column = "text", path: str | None = None, pattern: str | None = None, back: bool = False) -> DataFrame:
    """(key, ids): the whole text's ids as little-endian unsigned 32-bit integers; with back
    also `decoded`, the bytes that these ids stand for, from the same pass.

    path: a file of ranks that every executor has. A null text counts as empty and has no
    ids; null keys and repeated rows come back as they are; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    text = F.col(text) if isinstance(text, str) else text

    def run(t: pa.Table) -> pa.Table:
        of = replay(path)
        ids = of.encode(t["text"].to_pylist(), pattern)
        out = pa.table([t["key"], pa.array(ids, pa.binary())], ["key", "ids"])
        return out.append_column("decoded", pa.array(list(map(of.decode, ids)), pa.binary())) if back else out

    slim = table_columns(docs, {"key": F.col(key), "text": F.coalesce(text, F.lit(""))})
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(each_table(run, CORPUS_BYTES), f"key {kind}, ids binary" + (", decoded binary" if back else "")).withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, ids, decoded): the bytes that the ids stand for. Null ids decode to no bytes."""
    ready(encoded.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(t: pa.Table) -> pa.Table:
        ids = t["ids"].to_pylist()
        return pa.table([t["key"], pa.array(ids, pa.binary()), pa.array(list(map(replay(path).decode, ids)), pa.binary())], ["key", "ids", "decoded"])

    slim = table_columns(encoded, {"key": F.col(key), "ids": F.coalesce(F.col(ids), F.lit(b""))})
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(each_table(run), f"key {kind}, ids binary, decoded binary").withColumnsRenamed({"key": key})


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    both = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), back=True)
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
