"""Encoding of texts with a public byte-level BPE vocabulary.

The vocabulary, a file of byte strings with ranks, is serialised as a
sentencepiece BPE model: each byte string becomes a piece of one printable
character a byte, scored with its negative rank, and normalisation is the
identity. Merging the best-scored pair first is then merging the lowest rank
first, as in byte-level BPE. A text is cut into pre-tokens; distinct pre-tokens
are encoded once a task and looked up after that.

Plan: one map over the documents, no shuffle. The model is built on the driver
(about 1 MB whatever the corpus) and broadcast, so executors need no files.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern of pre-tokens that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: distinct pre-tokens a task keeps; beyond it the cache starts anew (results are the same)
CACHE = 400_000
#: documents of one output batch
BATCH = 2_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a vocabulary file with their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _bytes(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks.

    Ranks must be 0 to n-1; id n is the unknown piece that the format demands
    (no text yields it, since every byte is a piece).
    """
    char = byte_characters()
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        name = "".join(char[b] for b in token).encode()
        # a piece: its text (1), score (2, a float), type (3, 1 for normal)
        pieces[rank] = _bytes(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int(3, 1)
    unknown = _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int(3, 2)
    # model type BPE (3: 2), vocabulary size (4), ids of unknown, begin, end and padding (40-43)
    trainer = _int(3, 2) + _int(4, len(ranks) + 1) + _int(40, len(ranks)) + _int(41, -1) + _int(42, -1) + _int(43, -1)
    # identity: no prefix (3), white space neither removed (4) nor escaped (5)
    normalizer = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join(_bytes(1, p) for p in [*pieces, unknown]) + _bytes(2, trainer) + _bytes(3, normalizer)


class Encoder:
    """Texts to ids and back, on one worker."""

    def __init__(self, model: bytes) -> None:
        import regex
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(PATTERN).findall
        self.char = byte_characters()
        self.byte = {c: b for b, c in enumerate(self.char)}
        self.latin = {i: c for i, c in enumerate(self.char)}
        self.known: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}

    def split(self, text: str | None) -> list[str]:
        """The pre-tokens of a text; together they are the text."""
        return self.find(text) if text else []

    def learn(self, tokens: set[str]) -> None:
        """Encode the pre-tokens that aren't known yet."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(tokens - self.known.keys())
        if new:
            mapped = [t.encode().decode("latin-1").translate(self.latin) for t in new]
            self.known.update(zip(new, self.model.encode(mapped, num_threads=1)))

    def count_split(self, split: list[list[str]]) -> list[list[int]]:
        """The number of ids of each pre-token of each text."""
        tokens = set(chain.from_iterable(split))
        if len(self.sizes) > CACHE:
            self.sizes.clear()
        new = tokens - self.sizes.keys()
        if new:
            self.known.clear()
            self.learn(new)
            self.sizes.update((t, len(ids)) for t, ids in self.known.items())
        get = self.sizes.__getitem__
        return [list(map(get, s)) for s in split]

    def encode_split(self, split: list[list[str]]) -> list[list[list[int]]]:
        """The ids of each pre-token of each text."""
        self.learn(set(chain.from_iterable(split)))
        get = self.known.__getitem__
        return [list(map(get, s)) for s in split]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable(ids)) for ids in self.encode_split([self.split(t) for t in texts])]

    def token_bytes(self, i: int) -> bytes:
        return bytes(self.byte[c] for c in self.model.id_to_piece(i))

    def decode(self, ids: list[int]) -> str:
        """The inverse of encode; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes, ids)).decode(errors="replace")


def broadcast_model(spark: SparkSession, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    return spark.sparkContext.broadcast(sentencepiece_model(read_ranks(f"{directory}/{vocabulary}")))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row, without special tokens.

    NULL and empty texts have an empty list. Blank, very long and repeated texts
    are ordinary texts; rows come out once each. Only the two columns are read.
    """
    model = broadcast_model(docs.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                split = [encoder.split(t) for t in part.column(1).to_pylist()]
                encoder.learn(set(chain.from_iterable(split)))
                get = encoder.known.__getitem__
                lists = [list(chain.from_iterable(map(get, s))) for s in split]
                ends = np.cumsum([0, *map(len, lists)])
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the texts of id lists; the text of an empty list is empty, of a NULL list NULL."""
    model = broadcast_model(encoded.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        table = [encoder.token_bytes(i) for i in range(encoder.model.get_piece_size() - 1)]
        for batch in batches:
            texts = [None if ids is None else b"".join(table[i] for i in ids).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the length of every text in tokens; 0 for NULL and empty ones."""
    model = broadcast_model(docs.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            counts = []
            for at in range(0, batch.num_rows, BATCH):
                counts += map(sum, encoder.count_split([encoder.split(t) for t in batch.column(1).slice(at, BATCH).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
