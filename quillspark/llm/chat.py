"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as ``<|im_start|>role<|im_sep|>text<|im_end|>\\n`` for each turn, by rising turn, and
encoded once with offsets. The sorted spans of the assistant texts are intersected with the token spans by binary
search. Control strings inside roles and texts are escaped reversibly: ``<``, k backslashes and ``|`` becomes the same
with k + 1 backslashes, so no ``<|`` of a text remains. The marks are single tokens of their own, so tokens never run
from one turn into the next or from a mark into a text, and very long conversations may be encoded in segments of turns
with the same ids.

Digests are read back from the formatted text, the token spans and the mask in the task that made them. Conversations of
one segment, nearly all, are done there; of longer ones only the turns and the text under the mask are sent on, to be
digested in order of segments.

Defined cases: null roles and texts count as empty; null turns come first; equal turns go by role, then text, and
repeated rows are turns of their own; rows with a null conversation id form one conversation; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turns whose numbers fall into one run of this length are encoded together; a segment also ends at so many characters.
SEGMENT_TURNS, SEGMENT_CHARS = 256, 1 << 22
#: Ids of conversations of several segments up to this many are broadcast (8 bytes each), else joined by shuffle.
BROADCAST_CONVERSATIONS = 500_000
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)

FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("token_starts", T.ArrayType(T.IntegerType())),
        T.StructField("token_ends", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.ByteType())),
    ]
)
PIECES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns", T.BinaryType()),
        T.StructField("loss", T.BinaryType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
    ]
)
COUNTS = ["n_turns", "loss_chars", "formatted_chars", "n_tokens", "loss_tokens"]
DIGESTS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_sha256", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the sorted spans of the assistants' texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def aligned(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token whose span meets one of the sorted spans."""
    if not spans:
        return np.zeros(len(starts), dtype=np.int8)
    first, last = np.array(spans, dtype=np.int64).T
    k = np.searchsorted(last, starts, side="right")  # the first span that ends behind the token's start
    inside = k < len(last)
    return (inside & (first[np.minimum(k, len(last) - 1)] < ends)).astype(np.int8)


_tokenizers: dict[int, object] = {}


def tokenizer_for(spec_json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(spec_json)
    if key not in _tokenizers:
        tokenizer = Tokenizer.from_str(spec_json)
        tokenizer.add_special_tokens([START, SEPARATOR, END])
        _tokenizers[key] = tokenizer
    return _tokenizers[key]


def in_segments(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, turn, role, text), nulls replaced."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.floor(F.coalesce(F.col("turn").cast("bigint"), F.lit(-SEGMENT_TURNS)) / SEGMENT_TURNS).cast("bigint").alias("segment"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def dealt_in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", F.col("turn").asc_nulls_first(), "role", "text")


def formatted_segments(conversations: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row for each segment of a conversation (mostly one): the text, its ids, token spans and loss mask."""
    shared = _vocabulary(conversations, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _formatted(batches, tokenizer_for(shared.value))

    return dealt_in_order(in_segments(conversations)).select("conv_id", "segment", "role", "text").mapInArrow(run, FORMATTED)


def conversation_digests(conversations: DataFrame, vocabulary_path: str) -> DataFrame:
    """Counts and digests of what the formatted segments hold, one row for each conversation."""
    shared = _vocabulary(conversations, vocabulary_path)
    rows = in_segments(conversations)
    extent = rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.min("segment").alias("first"), F.max("segment").alias("last"))
    long = cut(extent.filter("first < last").select("long_id", F.lit(True).alias("is_long")))
    if long.count() <= BROADCAST_CONVERSATIONS:
        long = F.broadcast(long)
    marked = rows.join(long, rows["conv_id"].eqNullSafe(long["long_id"]), "left").withColumn("is_long", F.col("is_long").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _Digest(None)
        for batch in _formatted(batches, tokenizer_for(shared.value), with_long=True):
            long_ones, segments = batch.column(len(FORMATTED.names)).to_pylist(), list(_read_back(batch))
            out = []
            for is_long, piece in zip(long_ones, segments, strict=True):
                if is_long:
                    out.append(piece)
                elif piece[2] == 0:
                    out += whole.close()
                    whole = _Digest(piece[0]).add(piece[3:])
                else:
                    whole.add(piece[3:])
            if out:
                yield _records(out, PIECES)
        if last := whole.close():
            yield _records(last, PIECES)

    pieces = dealt_in_order(marked).select("conv_id", "segment", "role", "text", "is_long").mapInArrow(run, PIECES)
    return digested(pieces)


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _formatted(batches: Iterator[pa.RecordBatch], tokenizer, with_long: bool = False) -> Iterator[pa.RecordBatch]:
    """FORMATTED rows from rows in order of conversation, segment and turn; ``is_long`` goes along if asked for."""
    ready: list[tuple] = []
    key, part, turns, size, ready_size = None, 0, [], 0, 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            place = (row[0], row[1], *row[4:])
            if place != key or size >= SEGMENT_CHARS:
                if turns:
                    ready.append((key, part, turns))
                    ready_size += size
                part = part + 1 if place == key else 0
                key, turns, size = place, [], 0
                if len(ready) >= 256 or ready_size >= SEGMENT_CHARS:
                    yield encoded(tokenizer, ready, with_long)
                    ready, ready_size = [], 0
            turns.append((row[2], row[3]))
            size += len(row[2]) + len(row[3])
    if turns:
        ready.append((key, part, turns))
    if ready:
        yield encoded(tokenizer, ready, with_long)


def encoded(tokenizer, segments: list[tuple], with_long: bool) -> pa.RecordBatch:
    rendered = [render(turns) for *_, turns in segments]
    coded = tokenizer.encode_batch([text for text, _ in rendered], add_special_tokens=False)
    lengths = np.array([len(c) for c in coded], dtype=np.int64)
    bounds = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    offsets = [np.fromiter(itertools.chain.from_iterable(c.offsets), dtype=np.int32, count=2 * n).reshape(-1, 2) for c, n in zip(coded, lengths.tolist(), strict=True)]
    masks = [aligned(o[:, 0], o[:, 1], spans) for o, (_, spans) in zip(offsets, rendered, strict=True)]
    flat = np.concatenate(offsets)

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(bounds, pa.array(values))

    columns = [
        *[pa.array([key[k] for key, *_ in segments], type=pa.int64()) for k in (0, 1)],
        pa.array([part for _, part, _ in segments], type=pa.int64()),
        pa.array([len(turns) for *_, turns in segments], type=pa.int64()),
        pa.array([text for text, _ in rendered], type=pa.string()),
        lists(np.concatenate([np.array(c.ids, dtype=np.int32) for c in coded])),
        lists(np.ascontiguousarray(flat[:, 0])),
        lists(np.ascontiguousarray(flat[:, 1])),
        lists(np.concatenate(masks)),
    ]
    names = list(FORMATTED.names)
    if with_long:
        columns.append(pa.array([key[2] for key, *_ in segments], type=pa.bool_()))
        names.append("is_long")
    return pa.RecordBatch.from_arrays(columns, names=names)


def loss_text(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped; tokens that share a character count it once."""
    at = np.flatnonzero(mask)
    if not len(at):
        return ""
    s, reached = starts[at], np.maximum.accumulate(ends[at])
    fresh = np.flatnonzero(np.r_[True, s[1:] > reached[:-1]])
    return "".join(unescape(text[a:b]) for a, b in zip(s[fresh].tolist(), reached[np.r_[fresh[1:] - 1, len(at) - 1]].tolist(), strict=True))


def _read_back(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A PIECES row for each formatted segment."""
    columns = {name: batch.column(k) for k, name in enumerate(FORMATTED.names)}
    bounds = columns["input_ids"].offsets.to_numpy()
    starts, ends, mask = (columns[c].values.to_numpy() for c in ("token_starts", "token_ends", "loss_mask"))
    ids = zip(*[columns[c].to_pylist() for c in ("conv_id", "segment", "part", "formatted")], strict=True)
    for (conv_id, segment, part, text), a, b in zip(ids, bounds.tolist(), bounds[1:].tolist(), strict=False):
        turns = TURN.findall(text)
        told = "".join(f"{unescape(role)}\n{unescape(body)}\n" for role, body in turns)
        loss = loss_text(text, starts[a:b], ends[a:b], mask[a:b])
        yield conv_id, segment, part, len(turns), told.encode("utf-8", "replace"), loss.encode("utf-8", "replace"), len(loss), len(text), b - a, int(mask[a:b].sum())


class _Digest:
    """The running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts = conv_id, [0] * len(COUNTS)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: tuple) -> _Digest:
        n_turns, turns, loss, *counts = piece
        self.turns.update(turns)
        self.loss.update(loss)
        self.counts = [a + b for a, b in zip(self.counts, (n_turns, *counts), strict=True)]
        return self

    def close(self) -> list[tuple]:
        """One PIECES row, of segment null, with digests in place of texts; none if nothing was added."""
        n_turns, *counts = self.counts
        return [(self.conv_id, None, 0, n_turns, self.turns.hexdigest().encode(), self.loss.hexdigest().encode(), *counts)] if n_turns else []


def digested(pieces: DataFrame) -> DataFrame:
    """DIGESTS rows from PIECES: those of segment null are done, the others are taken in order."""
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = _Digest(None)

        def told(rows: list[tuple]) -> list[tuple]:
            return [(conv_id, turns.decode(), loss.decode(), n_turns, *counts) for conv_id, _, _, n_turns, turns, loss, *counts in rows]

        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[1] is None:
                    done.append(row)
                    continue
                if row[0] != current.conv_id:
                    done += current.close()
                    current = _Digest(row[0])
                current.add(row[3:])
            if done:
                yield _records(told(done), DIGESTS)
        if last := current.close():
            yield _records(told(last), DIGESTS)

    return dealt.mapInArrow(run, DIGESTS).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens")


def _records(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[f.dataType]) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)], names=schema.names)
