"""Encoding with a public byte-level BPE vocabulary, by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up all neighbouring pairs by binary search over the
sorted pair keys, takes the lowest rank of every word, merges all its occurrences at once and drops the words that
are done. Words recur, so every Python worker keeps the codes of those it has met, in a table of bounded size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files (a parameter everywhere; never copied).
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text into words before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers (about 100 bytes each), and characters it handles at once.
REMEMBERED, AT_ONCE = 400_000, 400_000
NONE = np.iinfo(np.int64).max


class Encoder:
    """Ids of texts; ids of single words are remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        import regex

        self.split = regex.compile(PATTERN).findall
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        done_symbols, done_word = [], []
        while len(symbols):
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], NONE), NONE)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            lowest = np.minimum.reduceat(rank, start)
            finished = np.repeat(lowest == NONE, size)
            hit = (rank == np.repeat(lowest, size)) & ~finished
            # in a run of hits (a symbol repeated) every second one overlaps the one before
            pos = np.flatnonzero(hit)
            if len(pos):
                run = np.flatnonzero(np.r_[True, np.diff(pos) != 1])
                nth = np.arange(len(pos)) - np.repeat(run, np.diff(np.r_[run, len(pos)]))
                pos = pos[nth % 2 == 0]
            symbols[pos] = rank[pos]
            keep = ~finished
            keep[pos + 1] = False
            done_symbols.append(symbols[finished])
            done_word.append(word[finished])
            symbols, word = symbols[keep], word[keep]
        owner = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has; null and '' have none."""
        index: dict[str, int] = {}
        flat: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                parts = self.split(text)
                per_text[i] = len(parts)
                flat += [index.setdefault(p, len(index)) for p in parts]
        if not flat:
            return np.zeros(0, np.int32), per_text
        unknown = [w for w in index if w not in self.known]
        if unknown:
            if len(self.known) + len(unknown) > REMEMBERED:
                self.known = {}
                unknown = list(index)
            ids, count = self.merge([w.encode("utf-8", "replace") for w in unknown])
            end = np.cumsum(count) * 4
            raw = ids.tobytes()
            self.known.update((w, raw[e - 4 * c : e]) for w, e, c in zip(unknown, end.tolist(), count.tolist()))
        codes = [self.known[w] for w in index]
        ids = np.frombuffer(b"".join(codes), np.int32)
        count = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        word = np.array(flat)
        n = count[word]
        base = (np.cumsum(count) - count)[word]
        out = ids[np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.r_[0, np.cumsum(n)][np.cumsum(per_text)]
        return out, np.diff(np.r_[0, ends])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in lists of about AT_ONCE characters; never splits a text."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: ids array<int>, without special tokens; their spellings in a text are plain text.

    Null and empty text give an empty list; repeated rows stay; an empty table gives none.
    """
    path = os.path.join(tokenizers, vocabulary)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        code = encoder(path)
        for b in batches:
            keys, at = b.column(0), 0
            for part in chunks(b.column(1).to_pylist()):
                ids, n = code(part)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), lists], [key, "ids"])
                at += len(part)

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens) of every row: how many ids its text has."""
    path = os.path.join(tokenizers, vocabulary)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        code = encoder(path)
        for b in batches:
            n = [code(part)[1] for part in chunks(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n) if n else [], pa.int64())], [key, "tokens"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens bigint")


