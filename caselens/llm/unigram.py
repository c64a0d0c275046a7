"""Token counts without tokens: a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a piece of text; dynamic
programming over end positions carries the best score and the number of pieces on the best
path, never the pieces themselves. Ties go as in the tokenizers library's unigram model:
starts are tried from the left and only a strictly better score replaces a path, so the
longest last piece wins. A character without a piece of its own costs the lowest score less
UNKNOWN_PENALTY and counts as its UTF-8 bytes (byte fallback).

Pieces of the vocabulary hold the blank mark only at their start, or hold nothing else, so
no piece spans the place where a blank follows another character. There a text is cut;
each distinct cut is searched once for each task.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import each_table, ready, table_columns

#: Fixed values of unigram models with byte fallback.
UNKNOWN_PENALTY = 10.0
MARK = "▁"

#: Distinct cuts that a worker remembers.
REMEMBERED = 1_200_000


class Counter:
    """vocabulary: (piece, score) of the pieces that text can match."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.known: dict[str, int] = {}

    def piece_count(self, s: str) -> int:
        """The pieces on the best path through s; bytes for characters without a piece.

        Unknown characters only compete where no single piece matches, as the search adds
        them for starts without a match of one character.
        """
        n, single, unknown = len(s), self.single, self.unknown
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at, best, steps = 0, None, 0
        for end, (size, value) in self.automaton.iter(s):  # by end; at one end the longer match, that is the earlier start, first
            while at < end:
                if s[at] not in single and (best is None or score[at] + unknown > best):
                    best, steps = score[at] + unknown, count[at] + len(s[at].encode("utf-8", "surrogatepass"))
                at += 1
                score[at], count[at] = best, steps
                best = None
            total = score[end + 1 - size] + value
            if best is None or total > best:
                best, steps = total, count[end + 1 - size] + 1
        while at < n:
            if s[at] not in single and (best is None or score[at] + unknown > best):
                best, steps = score[at] + unknown, count[at] + len(s[at].encode("utf-8", "surrogatepass"))
            at += 1
            score[at], count[at] = best, steps
            best = None
        return count[n]


class TextCounter(Counter):
    """Counts whole texts: a mark goes before the text, and blanks become marks."""

    def counts(self, texts: list[str]) -> list[int]:
        known, out = self.known, []
        for t in texts:
            if not t:
                out.append(0)
                continue
            words = t.split(" ")
            if "" in words or MARK in t:  # runs of blanks: marks that may match as one piece
                words = _cuts(MARK + t.replace(" ", MARK))
                out.append(sum(self.piece_count(w) if w[:2] == MARK * 2 or w[:1] != MARK or w == MARK else self._one(w[1:]) for w in words))
                continue
            look = known.get
            total = 0
            for w in words:
                c = look(w)
                total += self._one(w) if c is None else c
            out.append(total)
        return out

    def _one(self, w: str) -> int:
        if (c := self.known.get(w)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            c = self.known[w] = self.piece_count(MARK + w)
        return c


def _cuts(s: str) -> list[str]:
    """s cut before each mark that follows another character."""
    out, start = [], 0
    for i in range(1, len(s)):
        if s[i] == MARK and s[i - 1] != MARK:
            out.append(s[start:i])
            start = i
    return [*out, s[start:]]


@functools.cache
def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces that can match text, and their scores: neither control nor byte pieces.

    Pieces of blanks alone have a score of -1e9 in the file, which no search would pick
    over single marks; they are kept as they are.
    """
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


@functools.cache
def counter(path: str) -> TextCounter:
    return TextCounter(vocabulary(path))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str | Column = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): tokens of each whole text under the vocabulary in the file.

    Null and empty texts have 0 tokens; null keys and repeated rows come back as they are;
    an empty table gives no rows; other columns are not looked at. A text is bounded by its
    row alone: the search holds three numbers for each position of a cut.
    """
    ready(docs.sparkSession)
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    text = F.col(text) if isinstance(text, str) else text

    def run(t: pa.Table) -> pa.Table:
        return pa.table([t["key"], pa.array(counter(path).counts(t["text"].to_pylist()), pa.int64())], ["key", "n_tokens"])

    slim = table_columns(docs, {"key": F.col(key), "text": F.coalesce(text, F.lit(""))})
    return slim.mapInArrow(each_table(run, 8 << 20), f"key {slim.schema['key'].dataType.simpleString()}, n_tokens long").withColumnRenamed("key", key)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
