"""Splitting oversized texts at natural boundaries, by recursive bisection.

A span of tokens that is longer than the limit minus the overlap is cut in two at
the strongest boundary near its middle: in the middle half of the span, the end
of a paragraph before that of a line, a sentence, a clause, a word and any other
pre-token; of equals the one nearest to the middle. Both halves are treated alike.
Then each piece but the first is extended to the left by the overlap.

Plan: one map over the documents, no shuffle; texts within the limit only pay for
their encoding.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statloom.llm.tokenizer import TOKENIZER_DIR, VOCABULARY, Encoder, broadcast_model

LIMIT = 512
OVERLAP = 64
# What ends at a boundary, from the strongest kind to the weakest; a boundary is
# where the match ends. Words and other pre-tokens come after these.
ENDS = {
    "paragraph": r"\n\s*\n",
    "line": r"[\n\r\u2028\u2029]+",
    "sentence": r"[.!?…؟।]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』”）]*|</p>|<br ?/?>",
    "clause": r"[,;:،؛–—]+(?=\s)|[、，；：]|[}\]],|</\w+>",
}
BATCH = 500


class Splitter:
    """Texts to pieces, on one worker."""

    def __init__(self, model: bytes, limit: int, overlap: int) -> None:
        self.encoder = Encoder(model)
        self.limit, self.overlap = limit, overlap
        self.lengths = [len(self.encoder.model.id_to_piece(i)) for i in range(self.encoder.model.get_piece_size())]
        self.seen: dict[str, tuple[bytes, list[int], np.ndarray]] = {}
        self.ends = [(kind, re.compile(p).finditer) for kind, p in ENDS.items()]

    def _character(self, token: int, first: list[int], starts: list[int], split: list[str]) -> tuple[int, int]:
        """(token, character) of the last token at or before ``token`` that begins with a character."""
        j = bisect_right(first, token) - 1
        if j >= len(split) or first[j] == token:
            return token, starts[j]
        raw, ends, heads = self._bytes(split[j])
        i = token - first[j]
        while i and raw[ends[i]] & 0xC0 == 0x80:  # inside a character
            i -= 1
        return first[j] + i, starts[j] + int(heads[ends[i]])

    def _bytes(self, pretoken: str) -> tuple[bytes, list[int], np.ndarray]:
        """The bytes of a pre-token, where its tokens begin in them, and how many characters begin before each; of the last few asked for."""
        if pretoken not in self.seen:
            if len(self.seen) >= 64:
                self.seen.clear()
            ids = self.encoder.encode([pretoken])[0]
            raw = pretoken.encode()
            heads = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80, out=heads[1:])
            self.seen[pretoken] = raw, [0, *accumulate(map(self.lengths.__getitem__, ids))], heads
        return self.seen[pretoken]

    def _cut(self, text: str, a: int, b: int, first: list[int], starts: list[int], split: list[str]) -> tuple[int, int, str]:
        """(token, character, kind) of the cut of the tokens a to b: strongest kind first, then nearest to the middle."""
        middle, quarter = (a + b) / 2, max(1, (b - a) // 4)
        left, right = bisect_left(first, a + quarter), bisect_right(first, b - quarter) - 1
        if left > right:  # one long pre-token fills the middle half
            return (*self._character(round(middle), first, starts, split), "token")
        centre = starts[bisect_left(first, middle, left, right)]
        for kind, find in self.ends:
            best = None
            for m in find(text, starts[max(0, left - 2)], min(len(text), starts[right] + 2)):
                j = bisect_left(starts, m.end(), left)
                if j <= right and starts[j] == m.end() and (best is None or abs(first[j] - middle) < abs(first[best] - middle)):
                    best = j
                elif best is not None and m.end() > centre:
                    break  # ends only move away from the middle
            if best is not None:
                return first[best], starts[best], kind
        near = sorted(range(left, min(right + 1, len(split))), key=lambda j: abs(first[j] - middle))
        j = next((j for j in near if split[j][:1].isspace()), near[0])
        return first[j], starts[j], "word" if split[j][:1].isspace() else "token"

    def pieces(self, text: str | None, split: list[str], sizes: list[int]) -> list[tuple]:
        """(piece_no, start_token, end_token, overlap_tokens, start_char, end_char, boundary, text)."""
        n = sum(sizes)
        if n <= self.limit:
            return [(0, 0, n, 0, 0, len(text or ""), None, text)]
        first = [0, *accumulate(sizes)]
        starts = [0, *accumulate(map(len, split))]
        # a character has at most four tokens; the slack is for beginning at one
        room = max(1, self.limit - self.overlap - (0 if text.isascii() else 3))
        edges, spans = [(0, 0, None)], [(0, n)]
        while spans:
            a, b = spans.pop()
            if b - a > room:
                cut = self._cut(text, a, b, first, starts, split)
                if a < cut[0] < b:
                    edges.append(cut)
                    spans += [(a, cut[0]), (cut[0], b)]
        edges.sort(key=lambda e: e[0])
        out = []
        for i, (token, _, kind) in enumerate(edges):
            end, last = edges[i + 1][:2] if i + 1 < len(edges) else (n, len(text))
            begin, char = self._character(max(0, token - self.overlap), first, starts, split) if i else (0, 0)
            out.append((i, begin, end, token - begin, char, last, kind, text[char:last]))
        return out


SCHEMA = "piece_no int, start_token int, end_token int, overlap_tokens int, start_char int, end_char int, boundary string, text string"


def split_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: key, piece_no, start_token, end_token, overlap_tokens, start_char, end_char, boundary, text.

    Tokens are counted in the document's own encoding; no piece has more than
    ``limit``. ``overlap_tokens`` of the piece before are repeated: ``overlap``,
    and up to three more where a piece would otherwise begin inside a character.
    ``boundary`` is what the piece was cut at on its left, NULL for the first.
    Without overlaps the pieces of a document are its text again. Texts within
    the limit, also NULL and empty ones, are one piece as they are. Repeated rows
    are split each.
    """
    if not 0 <= overlap < limit - 7:
        raise ValueError("the overlap must be well below the limit")
    model = broadcast_model(docs.sparkSession, directory, vocabulary)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int32() for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(model.value, limit, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(1).to_pylist()
                split = [splitter.encoder.split(t) for t in texts]
                sizes = splitter.encoder.count_split(split)
                per = [splitter.pieces(t, s, n) for t, s, n in zip(texts, split, sizes)]
                keys = part.column(0).take(pa.array([i for i, p in enumerate(per) for _ in p], pa.int32()))
                columns = list(zip(*chain.from_iterable(per)))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[key, *names])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
