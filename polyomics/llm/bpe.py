"""Problem 6: exact byte-pair encoding of texts with the ranks of a public tokenizer.

A text is split by the tokenizer's pattern; distinct chunks and words are encoded once and kept. A word's bytes are read as Latin-1, so that
an Aho-Corasick automaton over the vocabulary finds every token in it in one pass. From the left the longest token is tried that
may follow the one before, then shorter ones, stepping back where none fits; a position that led nowhere isn't tried again, which
makes the search linear. Two tokens may be neighbours if the merges of the two together give just the two; this is memoised. A
token sequence whose neighbours are all compatible is the sequence the merges give.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Chunks and words, and pairs of tokens, a worker remembers before it starts afresh.
REMEMBERED = 300_000
PAIRS = 1_000_000
NO_RANK = 1 << 60


def _character_class(major: str) -> str:
    """A class with the code points of the Unicode categories beginning with ``major``."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == major]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(points), lambda x: x[1] - x[0])]
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


#: White_Space of Unicode, the tokenizer's blank. That of ``re`` also has the separators U+001C to U+001F.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Blanks and the signs up to the next blank. The tokenizer always splits there, so that chunks can be encoded one by one.
CHUNK = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")


@lru_cache(maxsize=1)
def pattern() -> re.Pattern:
    """The pattern that splits text before the merges: letters, digits, contractions, other signs, blanks (a fixed value of the public
    tokenizer), with the letter and number classes spelt out for ``re``. What is met most often is tried first; no text can begin
    with both a letter or digit and a contraction."""
    letters, numbers = _character_class("L"), _character_class("N")
    return re.compile(f" ?[{letters}]+| ?[{numbers}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{BLANK}{letters}{numbers}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


#: The same for texts in ASCII. ``re`` has one table for these classes, and tries hundreds of ranges at the end of a run for the others.
ASCII_PATTERN = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Followers(dict):
    """Token -> the followers of that token if it may follow this one, else None; found when asked for. -1 is a word's start."""

    __slots__ = ("words", "token")

    def __init__(self, words: Words, token: int) -> None:
        self.words, self.token = words, token

    def __missing__(self, token: int) -> Followers | None:
        words = self.words
        words.pairs += 1
        ok = words.compatible(self.token, token) if self.token >= 0 else words.usable(token)
        self[token] = out = words.followers(token) if ok else None
        return out


class Words(dict):
    """Word of the pattern -> its token ids as bytes of 32-bit integers; a word that isn't there is encoded when asked for."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t).decode("latin-1"): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.length = {r: len(t) for t, r in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.pairs = 0
        self.followed: dict[int, Followers] = {}
        self.begins: dict[int, int] = {}
        self.sound: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})  # by side, as edge() gives them

    def merged(self, data: str, below: int = NO_RANK) -> list[str]:
        """The parts the merges of a rank lower than ``below`` leave, by definition: the adjacent pair of lowest rank first, the
        left one of equals. For a token or two, not for texts."""
        parts = list(data)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NO_RANK), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int, side: int) -> tuple:
        """The parts that stand at the left (0) or right (1) end of a token while it grows, linked from the whole to the byte: part, the
        rank of the merge that makes it, -1 for a byte, that of the one that takes it up, and the next part."""
        out, part, rank, taken = [], self.tokens[token], token, NO_RANK
        while len(part) > 1:
            out.append((part, rank, taken))
            part, taken = self.merged(part, rank)[-side], rank
            rank = self.ranks[part]
        linked: tuple = (part, -1, taken, None)
        for x in reversed(out):
            linked = (*x, linked)
        self.edges[side][token] = linked
        return linked

    def compatible(self, a: int, b: int) -> bool:
        """May b follow a? Not if, while both grow, a part at the end of a and one at the start of b would be merged with each
        other before either is taken up by its own token. Only parts that are there at the same time are tried: from the two whole
        tokens back, the merge of the higher rank is undone first, of equals that of b, which is the later."""
        ranks, (starts, ends) = self.ranks, self.edges
        x, x_made, x_taken, x_next = ends.get(a) or self.edge(a, 1)
        y, y_made, y_taken, y_next = starts.get(b) or self.edge(b, 0)
        while True:
            both = x + y
            if both in ranks and (rank := ranks[both]) < x_taken and rank <= y_taken:
                return False
            if x_made > y_made:
                x, x_made, x_taken, x_next = x_next
            elif y_next:
                y, y_made, y_taken, y_next = y_next
            else:
                return self.usable(b)

    def followers(self, token: int) -> Followers:
        out = self.followed.get(token)
        if out is None:
            out = self.followed[token] = Followers(self, token)
        return out

    def usable(self, a: int) -> bool:
        """Do the merges of the token's own bytes give it?"""
        ok = self.sound.get(a)
        if ok is None:
            ok = self.sound[a] = len(self.merged(self.tokens[a])) == 1
        return ok

    def shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of this one; -1 if there is none."""
        data = self.tokens[token]
        return next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)

    def search(self, text: str) -> list[int]:
        """The ids of a word's bytes, read as Latin-1, from longest matches with steps back. What is found about pairs and beginnings
        is kept."""
        if self.pairs > PAIRS:
            self.pairs = 0
            self.followed.clear()
        length, begins, matches = self.length, self.begins, self.automaton.iter_long
        dead = bytearray(len(text) + 1)
        path: list[int] = []
        at, here = 0, self.followers(-1)
        while True:
            for stop, token in matches(text, at):  # longest matches one after the other: every byte is a token, so none is left out
                after = here[token]
                if after is None or dead[stop + 1]:
                    break
                path.append(token)
                here = after
            else:
                return path
            at = stop + 1 - length[token]
            while True:  # from here on a shorter token, after which the longest matches begin anew
                nxt = begins.get(token)
                if nxt is None:
                    nxt = begins[token] = self.shorter(token)
                token = nxt
                if token < 0:
                    dead[at] = 1  # nothing fits here: step back
                    token = path.pop()
                    at -= length[token]
                    here = self.followers(path[-1] if path else -1)
                elif not dead[at + length[token]]:
                    after = here[token]
                    if after is not None:
                        break
            path.append(token)
            at += length[token]
            here = after

    def __missing__(self, word: str) -> bytes:
        text = word if word.isascii() else word.encode("utf-8", "replace").decode("latin-1")
        rank = self.ranks.get(text)
        ids = [rank] if rank is not None and self.usable(rank) else self.search(text)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = packed = array("i", ids).tobytes()
        return packed


class Encoder(dict):
    """Chunk -> the token ids of its words as bytes of 32-bit integers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.words = Words(path)
        self.ascii, self.any = ASCII_PATTERN.findall, pattern().findall

    def split(self, chunk: str) -> list[str]:
        """The words of the pattern."""
        return self.ascii(chunk) if chunk.isascii() else self.any(chunk)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        self[chunk] = packed = b"".join(map(self.words.__getitem__, self.split(chunk)))
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers; none for an empty one."""
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def encode(documents: DataFrame, tokenizer: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``documents`` (doc_id, text), without special tokens.

    Null and empty texts have no ids: the empty array. Texts are encoded whole, however long. A narrow map over Arrow batches: no
    shuffle, nothing kept but the worker's words. ``folder`` holds the vocabulary file on every executor.
    """
    path = os.path.join(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            packed = [enc.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(packed) + 1, "i4")
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count(documents: DataFrame, tokenizer: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source and n_tokens of every row of ``documents`` (doc_id, source, text); 0 for null and empty texts."""
    path = os.path.join(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = pa.array([len(enc.encode(t)) // 4 if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), n], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")
