"""Token ids and token counts inside tasks.

The byte-level ids come from the rank form of the vocabulary, which gives the same ids several times
faster.  The word vocabulary works word by word, so a bounded cache keeps the count of each distinct
word.  Texts with characters outside ``PLAIN`` (where the white-space and letter classes of two regular
expression engines might differ) and texts that hold a special string go to the tokenizer library whole.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

# Fixed value: character ranges on which all engines agree.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
# Entries of a word cache; it starts anew when full, which bounds the memory of a worker.
CACHE = 300_000
# Longer words bypass the cache.
LONG_WORD = 200


@functools.lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCache(dict):
    """Word to value; computes what is missing and keeps it unless the word is very long."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= LONG_WORD:
            self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()


class ByteEncoder:
    """Ids of the byte-level vocabulary as little-endian 16-bit bytes."""

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self.library = library(json_path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")

    def __call__(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u2").tobytes()
        return self.words.encode_to_numpy(text).astype("<u2").tobytes()


class WordCounter:
    """Token counts of the lower-case word vocabulary.

    ``whole`` holds each vocabulary string that was proved to encode alone as one token: the merges
    of the model, run on the string once, gave exactly one.  A pre-token found there counts one
    without any merge; only the others run the merges.
    """

    def __init__(self, json_path: str) -> None:
        import regex

        self.library = library(json_path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Fixed value: the pre-token rule of the vocabulary.
        self.pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.byte_char = _byte_characters()
        self.whole = self._prove()
        self.cache = WordCache(self._count_word)

    def _merged(self, piece: str) -> int:
        return len(self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.byte_char)))

    def _prove(self) -> frozenset[str]:
        back = {v: chr(k) for k, v in self.byte_char.items()}
        whole = set()
        for entry in self.library.get_vocab(with_added_tokens=False):
            if not entry.endswith("</w>"):
                continue
            raw = "".join(back.get(c, "Ā") for c in entry.removesuffix("</w>"))
            try:
                piece = raw.encode("latin-1").decode()
            except UnicodeError:
                continue
            if piece and self.pre.findall(piece) == [piece] and self._merged(piece) == 1:
                whole.add(piece)
        return frozenset(whole)

    def _count_word(self, word: str) -> int:
        return sum(1 if piece in self.whole else self._merged(piece) for piece in self.pre.findall(word))

    def __call__(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if PLAIN.fullmatch(text):
            words = text.lower().split()
        else:
            words = [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]
            if not all(map(PLAIN.fullmatch, words)):
                return len(self.library.encode(text, add_special_tokens=False).ids)
        n = sum(map(self.cache.__getitem__, words))
        self.cache.trim()
        return n


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or 256 and up in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def byte_encoder(json_path: str, ranks_path: str) -> ByteEncoder:
    return ByteEncoder(json_path, ranks_path)


@functools.lru_cache(maxsize=2)
def word_counter(json_path: str) -> WordCounter:
    return WordCounter(json_path)


def token_table(docs, json_path: str, ranks_path: str, end_id: int, *keep: str):
    """Columns ``keep``, ``ids`` (little-endian 16-bit ids, ``end_id`` last) and ``n`` of every row."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, end = byte_encoder(json_path, ranks_path), np.array([end_id], dtype="<u2").tobytes()
        for batch in texts:
            yield pd.Series([(encoder(t) if t else b"") + end for t in batch], dtype=object)

    return docs.select(*keep, encode("text").alias("ids")).withColumn(
        "n", (F.octet_length("ids") / 2).cast("long"))
