"""Best-fit packing of token sequences with a fixed number of open bins, kept in a bitset by free space."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import REMEMBERED, durable, memory, only

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space that a chunk boundary before a space would cut: such texts are encoded whole.
UNSAFE = re.compile(r"\s (?:\s|\Z)")


class BestFit:
    """Online best fit: a piece goes to the open bin that it fills best; with `open_bins` open, the fullest closes."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f is set if an open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = self.n_closed = 0

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of `length` tokens."""
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.n_bins
            self.n_bins += 1
        if left := free - length:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.n_closed += 1
        return bin_id, self.capacity - free


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: how ByteLevel pre-tokenizers cut a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(tokenizer_json: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes by rank, if the file is a plain byte-level BPE whose ids follow its merges; else None."""
    model, of, cut = tokenizer_json["model"], _bytes_of_symbols(), tokenizer_json.get("pre_tokenizer") or {}
    if tokenizer_json.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocabulary = model["vocab"]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    added = {t["content"] for t in tokenizer_json.get("added_tokens", ())}
    return {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in added}


class Encoder:
    """Token ids as little-endian 32-bit bytes, by a tokenizers file; the strings of its added tokens become their ids.

    A byte-level BPE never merges over a boundary before a single space, so a text is split there and each chunk's ids are
    remembered; texts with longer runs of white space or an added token's string are encoded whole. New chunks are merged
    by the file's own vocabulary as ranks, which takes half the time. Files of another kind encode all texts whole. Chunks
    of 64 characters or more are not remembered, and the memory is emptied at `most` chunks.
    """

    def __init__(self, tokenizer_path: str, most: int = REMEMBERED):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            parsed = json.load(f)
        self.added = [t["content"] for t in parsed.get("added_tokens", ())]
        ranks = _ranked(parsed)
        self.ranked = ranks and tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.most = most

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, text: str) -> bytes:
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            if not self.ranked or any(t in text for t in self.added):
                out.append(self.whole(text))
                continue
            if "\0" in text or UNSAFE.search(text):
                out.append(self._ids(text))
                continue
            chunks = text.replace(" ", "\0 ").split("\0")
            try:
                out.append(b"".join(map(known.__getitem__, chunks)))
            except KeyError:
                if len(known) > self.most:
                    known.clear()
                new = set(chunks).difference(known)
                for chunk in new:
                    known[chunk] = self._ids(chunk)
                out.append(b"".join(map(known.__getitem__, chunks)))
                for chunk in new:
                    if len(chunk) >= 64:
                        del known[chunk]
        return out


_ENCODERS: dict[str, Encoder] = memory()


def encoder(tokenizer_path: str) -> Encoder:
    """One encoder for each file in a worker process; workers serve many tasks."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `capacity`, but the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int, separator: int, texts_at_once: int = 256) -> Iterator[pa.RecordBatch]:
    only(_ENCODERS)
    encode, end = encoder(tokenizer_path).encode, np.array([separator], dtype="<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, texts_at_once):
            part = batch.slice(at, texts_at_once)
            out: list[list] = [[] for _ in range(5)]
            for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids += end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for values, v in zip(out, (doc_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document; a null text is empty, so one separator."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda batches: _pieces(batches, tokenizer_path, capacity, separator), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, open_bins: int = 256, pieces_per_group: int = 32_768, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document ends with the separator id; one of over `capacity` tokens is cut into pieces of `capacity`, the first
    maybe shorter. Full pieces are sequences by themselves, with negative numbers; each document has one other piece at
    most. Those are numbered as they come and dealt by a hash of the number into groups of about `pieces_per_group`; in
    each, the stream of pieces is packed with `open_bins` bins open, so no task holds more than a group's lengths, however
    many rows are equal. Repeated rows are packed each; null ids stay null; an empty table gives no rows. Columns other
    than the id and the text are not carried.
    """
    numbered = token_pieces(docs, tokenizer_path, capacity, separator, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    pieces = durable(numbered)  # texts are encoded once, and a task that runs again finds the same numbers
    partial = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-partial.count() // pieces_per_group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        bins = BestFit(capacity, open_bins)
        placed = [bins.place(n) for n in pdf["length"].tolist()]
        pdf["sequence_id"] = (int(pdf["g"].iloc[0]) << 36) + np.array([b for b, _ in placed], dtype="int64")
        pdf["offset"] = np.array([o for _, o in placed], dtype="int64")
        return pdf.drop(columns=["g", "row"])

    dealt = partial.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("g").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    return packed.unionByName(full)
