"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces inside a fragment; a dynamic program over end positions
carries the best score and the number of pieces of the best path. Ties follow the tokenizers' rule: pieces are tried by
rising start, and a later one wins only with a strictly better score. A character that no one-character piece covers
may become unknown, at the lowest score less 10, and counts as one token for each of its UTF-8 bytes (byte fallback).

Texts are prefixed with the space mark and spaces are replaced by it. No piece runs from another character into a
space mark, so every such place is a sure boundary; characters that no piece holds are boundaries too. Fragments
between boundaries are counted on their own and remembered.

Scores are summed from the start of a fragment. Two paths of equal score tie exactly where sums of their scores are
exact, as for whole numbers; other scores are sums in double precision, and a tie that rounding breaks may fall
otherwise than in sums over the whole text.

Defined cases: null and empty texts have 0 tokens; repeated rows and null ids give one row each; an empty table gives an
empty result; other columns, whatever their names, are kept out; texts are counted whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_CHARS, CACHED_FRAGMENTS = 48, 600_000


class UnigramCounter:
    """Counts the pieces of the best segmentation under ``pieces``: (piece, score), scores as double."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.chars = {c for piece, _ in pieces for c in piece}
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        inside = any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece, _ in pieces)
        apart = "".join(regex.escape(c) for c in "\n\t\r" if c not in self.chars)
        if inside:
            self.fragments = regex.compile(rf"[^{apart}]+|[{apart}]" if apart else r"(?s).+")
        else:
            self.fragments = regex.compile(rf"{SPACE_MARK}*[^{SPACE_MARK}{apart}]+|{SPACE_MARK}+" + (f"|[{apart}]" if apart else ""))
        self.cache: dict[str, int] = _Counts(self)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.cache.__getitem__, self.fragments.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))))

    def best(self, s: str) -> tuple[float, int]:
        """(score, number of tokens) of the best path through ``s``."""
        n = len(s)
        if self.single.issuperset(s):  # the automaton yields ends in order and, of one end, the longest piece first
            scores, counts = [None] * (n + 1), [0] * (n + 1)
            scores[0] = 0.0
            for last, (length, score) in self.automaton.iter(s):
                start, last = last + 1 - length, last + 1
                total = scores[start] + score
                if scores[last] is None or total > scores[last]:
                    scores[last], counts[last] = total, counts[start] + 1
            return scores[n], counts[n]
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(s):
            ending[last + 1].append((last + 1 - length, score))
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces = None, 0
            arcs = ending[end]
            c = s[end - 1]
            if c not in self.single:
                arcs.append((end - 1, self.unknown))
            arcs.sort(key=_start)
            for start, score in arcs:
                total = scores[start] + score
                if top is None or total > top:
                    unknown = start == end - 1 and c not in self.single
                    top, pieces = total, counts[start] + (len(c.encode("utf-8", "replace")) if unknown else 1)
            scores[end], counts[end] = top, pieces
        return scores[n], counts[n]


def _start(arc: tuple[int, float]) -> int:
    return arc[0]


class _Counts(dict):
    def __init__(self, counter: UnigramCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, fragment: str) -> int:
        n = self.counter.best(fragment)[1]
        if len(fragment) <= CACHED_CHARS:
            if len(self) >= CACHED_FRAGMENTS:
                self.clear()
            self[fragment] = n
        return n


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


_counters: dict[int, UnigramCounter] = {}


def token_counts(documents: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long) of every whole text. The vocabulary, of fixed size, is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(pieces)
    rows = documents.select(documents[id_col].alias("id"), documents[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(shared.value))
        if key not in _counters:
            _counters[key] = UnigramCounter(shared.value)
        counter = _counters[key]
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64())], names=["id", "n_tokens"])

    fields = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)
