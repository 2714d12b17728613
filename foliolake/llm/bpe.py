"""Exact byte-pair ids of whole texts by dynamic programming over prefixes.

For a fixed vocabulary every prefix of a piece of text has exactly one encoding, hence one last
token. An Aho-Corasick automaton over the vocabulary lists the tokens that end at a position; the last token is the only one
of them that may follow the last token of the prefix before it. That is a test on pairs: two tokens
are compatible if their joined bytes encode to just these two. Back-pointers then give the ids. The
work is linear in the text, however long a piece is without a break.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread

#: Where the vocabulary files lie on every node, and the one of the corpus queries.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"

#: Fixed value: the pattern that splits text into pieces before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bounds of what a worker remembers: pieces with their ids, and pairs of tokens.
_CACHED, _PAIRS = 200_000, 1_000_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(0x100 + i)] = b
    return letters


class Encoder:
    """Encoder of one vocabulary file of byte-level merges."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.ids = {b: i for i, b in self.bytes_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        vocab = model["vocab"]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.matcher = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.matcher.add_word(b.decode("latin-1"), (i, len(b)))
        self.matcher.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PIECES).findall
        self.cache: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids by merging lowest ranks first: the definition, for short strings and for tests."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def follows(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= _PAIRS:
                self.compatible.clear()
            known = self.compatible[pair] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8")
        if (whole := self.ids.get(data)) is not None and self._reachable(whole):
            return [whole]
        n = len(data)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        known, follows = self.compatible.get, self.follows
        for at, (token, length) in self.matcher.iter(data.decode("latin-1")):
            end = at + 1
            if last[end] < 0:
                start = end - length
                if start == 0:
                    if not self._reachable(token):
                        continue
                else:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = known((before, token))
                    if not (follows(before, token) if fits is None else fits):
                        continue
                last[end] = token
                size[end] = length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _reachable(self, token: int) -> bool:
        """Whether the token's own bytes encode to it; merges could leave a token that never comes out."""
        key = (-1, token)
        known = self.compatible.get(key)
        if known is None:
            known = self.compatible[key] = self.merged(self.bytes_of[token]) == [token]
        return known

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            cache, extend = self.cache, out.extend
            for p in self.split(text):
                ids = cache.get(p)
                if ids is None:
                    ids = self.piece(p)
                    if len(p) <= 48:
                        if len(cache) >= _CACHED:
                            cache.clear()
                        cache[p] = ids
                extend(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, built once in each Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{BYTE_BPE}", ids: str = "ids") -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens.

    A null and an empty text give an empty list; strings that look like special tokens are ordinary
    text. Repeated rows stay repeated, a null key stays null. One narrow stage: no shuffle except the
    dealing-out of a small input. The vocabulary is read from `path` on each executor.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            flat, ends = array("i"), np.zeros(batch.num_rows + 1, dtype=np.int32)
            for k, t in enumerate(batch.column(1)):
                flat.extend(model.encode(t.as_py()))
                ends[k + 1] = len(flat)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), F.col("ids").alias(ids))
