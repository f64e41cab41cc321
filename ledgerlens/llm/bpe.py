"""Encoding of texts with a public byte-level BPE vocabulary, and decoding.

The encoder backtracks over longest token matches (found by an Aho-Corasick automaton) and checks each new
token against its left neighbour in a pair-compatibility table: a sequence of tokens is what merging by rank
gives if and only if every adjacent pair is what merging gives for the two tokens' bytes. Each position is
left at most once in vain, so the time is linear in the text. Decoding uses one byte string of all tokens and a
table of offsets.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text.
The vocabulary file ("base64 rank" lines) is a parameter; nothing of it is kept in the repository.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary's tokenizer cuts a text into pieces, which are encoded one by one.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to ids. The file is read on the driver; a vocabulary has a fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(i) for t, i in (x.split() for x in lines if x.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pieces: str = PIECES, cache: int = 1 << 18):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pieces)
        self.cache_size = cache
        self.cache: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.prefix: dict[int, int] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Merging by rank as defined; only ever applied to the bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 1 << 20:
                self.pairs.clear()
            known = self.pairs[left, right] = self._merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token; -1 if there is none."""
        known = self.prefix.get(token)
        if known is None:
            t = self.tokens[token]
            known = self.prefix[token] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1)
        return known

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest = [0] * len(data)
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            longest[end - n + 1] = token  # ends come in order, so the last one is the longest
        out, starts = [], []
        fresh = bytearray(b"\1" * (len(data) + 1))  # positions not yet left in vain
        at, token = 0, longest[0]
        while True:
            end = at + len(self.tokens[token])
            if fresh[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                starts.append(at)
                at = end
                if at == len(data):
                    return out
                token = longest[at]
                continue
            token = self.shorter(token)
            if token < 0:
                fresh[at] = 0
                token, at = out.pop(), starts.pop()

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for p in self.pieces.findall(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(p) <= 64:
                    if len(cache) >= self.cache_size:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        order = sorted(ranks.items(), key=lambda x: x[1])
        assert [i for _, i in order] == list(range(len(order))), "ids are 0, 1, ..."
        self.data = b"".join(t for t, _ in order)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in order])])

    def decode(self, ids) -> str:
        o = self.offsets
        return b"".join(self.data[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


_made: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder a Python worker."""
    if shared.value is not _made.get("ranks"):
        _made.clear()
        _made["ranks"], _made["encoder"] = shared.value, Encoder(shared.value)
    return _made["encoder"]


def encode_column(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """(id_col, ids): the token ids of every row's text, rows as they are (repeated ones stay repeated)."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: of fixed size
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b in batches:
            flat, offsets, first = [], [0], 0
            for n, text in enumerate(b.column(1)):
                flat += encoder.encode(text.as_py())
                offsets.append(len(flat))
                if len(flat) > 1 << 21 or n + 1 == b.num_rows:  # bounds the memory of long texts
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n + 1 - first), ids], [id_col, "ids"])
                    flat, offsets, first = [], [0], n + 1

    return df.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def roundtrip(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """(id_col, n_ids, same): whether decoding gives the text again."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared), Decoder(shared.value)
        for b in batches:
            n, same = [], []
            for text in b.column(1).to_pylist():
                ids = encoder.encode(text)
                n.append(len(ids))
                same.append(decoder.decode(ids) == (text or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(same)], [id_col, "n_ids", "same"])

    return df.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_ids int, same boolean")
