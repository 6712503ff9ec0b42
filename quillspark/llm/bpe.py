"""BPE encoding and decoding by forced-boundary splitting.

Two bytes that stand side by side inside no vocabulary token can never be joined by a merge, so every such pair marks a
certain cut. A word is cut there, its fragments are encoded on their own, and the results are concatenated; merges on
both sides of a cut cannot influence each other, so the ids equal those of merging the whole word.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty string; repeated rows and
null ids give one row each; an empty table gives an empty result; a word of any length is encoded whole, in n log n time;
other columns are kept out.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Longer strings are encoded without being remembered; a worker forgets all of them at this many entries.
CACHED_CHARS, CACHED_ENTRIES = 48, 200_000
#: Fragments over this many bytes are merged with a heap.
LONG_FRAGMENT = 120
#: Python splits at these four, which are not white space to Unicode.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters of text that one Arrow batch of results stands for at most (one longer text makes a batch of its own).
BATCH_CHARS = 1 << 21


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in own else next(rest) for b in range(256)]


class BpeCodec:
    """Encoder and decoder for a ``tokenizers`` JSON file with a BPE model over a byte alphabet."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only byte-alphabet BPE models are supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        added = spec.get("added_tokens") or []
        self.tokens = [""] * (1 + max([*self.ids.values(), *(a["id"] for a in added)]))
        for token, k in self.ids.items():
            self.tokens[k] = token
        self.special = {a["content"]: a["id"] for a in added}
        for content, k in self.special.items():
            self.tokens[k] = content
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id) -> rank, and the joined token of each rank
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.joined = [self.ids[a + b] for a, b in pairs]
        self.nfc, self.lower = self._normalizers(spec.get("normalizer"))
        pattern, self.by_space = self._pattern(spec["pre_tokenizer"])
        self.words = regex.compile(pattern)
        self.spaced_decoding = spec.get("decoder") is None
        alphabet = byte_alphabet()
        self.inner = [self.ids.get(c) for c in alphabet]
        self.final = [self.ids.get(c + self.suffix) for c in alphabet]
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.joinable = self._joinable()
        self.parts: dict[str, bytes] = _Remembered(lambda word: np.array(self.word(word), dtype=np.int32).tobytes())
        #: Pre-tokens never hold white space, so a text may be split there first; most pieces have been met before.
        self.cache: dict[str, bytes] = _Remembered(lambda piece: b"".join(map(self.parts.__getitem__, self.words.findall(piece))))

    @staticmethod
    def _normalizers(node: dict | None) -> tuple[bool, bool]:
        parts = [] if node is None else node["normalizers"] if node["type"] == "Sequence" else [node]
        kinds = [p["type"] for p in parts]
        if set(kinds) - {"NFC", "Replace", "Lowercase"} or any(p["type"] == "Replace" and (p["pattern"], p["content"]) != ({"Regex": "\\s+"}, " ") for p in parts):
            raise ValueError(f"unsupported normalizers: {kinds}")  # white space is dropped by the word pattern anyway
        return "NFC" in kinds, "Lowercase" in kinds

    @staticmethod
    def _pattern(node: dict) -> tuple[str, bool]:
        """The pattern of pre-tokens, and whether it leaves white space out."""
        parts = node["pretokenizers"] if node["type"] == "Sequence" else [node]
        for p in parts:
            if p["type"] == "Split" and p["invert"] and p["behavior"] == "Removed":
                # the library's \s is Unicode white space, without the four separators that Python counts too
                return p["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"), True
            if p["type"] == "ByteLevel" and p.get("use_regex", True) and not p["add_prefix_space"]:
                return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"), False
        raise ValueError("unsupported pre-tokenizer")

    def _joinable(self) -> list[bytearray]:
        """256 x 256: whether two bytes stand side by side inside any token."""
        found = [bytearray(256) for _ in range(256)]
        for token in self.ids:
            body = [self.byte_of.get(c, -1) for c in (token.removesuffix(self.suffix) if self.suffix else token)]
            for a, b in zip(body, body[1:], strict=False):
                if a >= 0 and b >= 0:
                    found[a][b] = 1
        return found

    def normal(self, text: str) -> str:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: a capital sigma has one small form
        return text

    def encode_to_bytes(self, text: str | None) -> bytes:
        """The ids of a whole text as native 32-bit integers."""
        if not text:
            return b""
        if self.splitter is None or not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        out = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
            elif part:
                out.extend(self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> Iterator[bytes]:
        text = self.normal(text)
        if not self.by_space or any(c in text for c in SEPARATORS):
            return map(self.parts.__getitem__, self.words.findall(text))
        return map(self.cache.__getitem__, text.split())

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_to_bytes(text), dtype=np.int32).tolist()

    def word(self, word: str) -> list[int]:
        """The ids of one pre-token: cut at forced boundaries, merge inside the fragments, concatenate."""
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        out: list[int] = []
        start, left = 0, raw[0]
        for k in range(1, len(raw)):
            right = raw[k]
            if not self.joinable[left][right]:
                out += self.merged(ids[start:k])
                start = k
            left = right
        return out + self.merged(ids[start:])

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merges, always the one of lowest rank, of equal ones the leftmost."""
        if len(ids) > LONG_FRAGMENT:
            return self._merged_by_heap(ids)
        rank_of, joined, none = self.ranks.get, self.joined, len(self.joined)
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [joined[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank_of((ids[k], ids[k + 1]), none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.ranks[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k] if alive[k] else n
            if right >= n or self.ranks.get((ids[k], ids[right])) != rank:
                continue
            ids[k], alive[right], after[k] = self.joined[rank], False, after[right]
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (pair := (ids[left], ids[right])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], left))
            if after[k] < n:
                before[after[k]] = k
        return [x for x, lives in zip(ids, alive, strict=True) if lives]

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept. Without a decoder in the file, the library joins the tokens by spaces."""
        tokens = map(self.tokens.__getitem__, ids)
        if self.spaced_decoding:
            return " ".join(tokens)
        out = bytearray()
        for token in tokens:
            out += token.encode() if token in self.special else bytes(self.byte_of[c] for c in token)
        return out.decode("utf-8", "replace")


class _Remembered(dict):
    """Results for strings already met; bounded."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHED_ENTRIES:
                self.clear()
            self[key] = out
        return out


_codecs: dict[int, BpeCodec] = {}


def codec_for(spec_json: str) -> BpeCodec:
    """One codec for each vocabulary and Python worker."""
    key = hash(spec_json)
    if key not in _codecs:
        _codecs[key] = BpeCodec(json.loads(spec_json))
    return _codecs[key]


def slices(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` characters together."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_decode(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): every whole text encoded, and the decoding of those ids.

    The vocabulary, a file of fixed size, is read once on the driver and broadcast.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(documents[id_col].alias("id"), documents[text_col].cast("string").alias("text"))
    fields = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in slices(texts):
                coded = [codec.encode_to_bytes(t) for t in texts[start:stop]]
                offsets = np.zeros(len(coded) + 1, dtype=np.int32)
                np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                decoded = [codec.decode(flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, type=pa.string())],
                    names=["id", "ids", "decoded"],
                )

    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)
