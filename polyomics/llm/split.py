"""Problem 8: texts over a token limit cut into overlapping pieces at natural boundaries.

Every boundary of a text knows its farthest legal successor: the next cut of the strongest kind that keeps the piece, which begins
the overlap before the boundary, within the limit. Which cuts a greedy pass from the start would make is found by pointer doubling:
the successor table is joined with itself by position, so that it jumps 1, 2, 4, ... cuts, and each round doubles the cuts that are
known. The tables are array columns whose position is the key, one row per text, so that the joins need no shuffle.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyomics.llm.bpe import BYTE_BPE_50K, CHUNK, TOKENIZERS, Encoder, encoder

#: Tokens of a piece at most, and of what it repeats of the piece before at most.
LIMIT = 512
OVERLAP = 64
#: A cut of a stronger kind is taken if the piece is filled to this part.
FILL = 0.5
#: Stretches without blanks are taken apart if they have more tokens.
ATOM = 64

# The kinds of boundary, strongest first. A part begins with a rule, a MIME boundary or a forwarded header.
KINDS = ["part", "paragraph", "line", "sentence", "word", "inside"]
PART = re.compile(r"--|==|__|\*\*\*|~~~|From:|Content-Type:")
SENTENCE_END = re.compile(r"[.!?…:;。！？][\"'»”’)\]]*$")
#: The signs a sentence can end in.
LAST = frozenset(".!?…:;。！？\"'»”’)]")


def ends_sentence(text: str) -> bool:
    """Of a text that isn't empty. Most texts end in none of the signs, so that the pattern needn't look for them."""
    return text[-1] in LAST and SENTENCE_END.search(text) is not None


class Boundaries(dict):
    """Chunk -> the kind of the boundary before it, plus 8 if a sentence ends with it."""

    def __missing__(self, chunk: str) -> int:
        body = chunk.lstrip()
        breaks = chunk[: len(chunk) - len(body)].count("\n")
        kind = 4 if not breaks else 0 if PART.match(body) else 1 if breaks > 1 else 2
        if len(self) > 300_000:
            self.clear()
        self[chunk] = code = kind + 8 * ends_sentence(chunk)
        return code


def atoms(enc: Encoder, chunk: str) -> list[tuple[str, int, int]]:
    """A long chunk's parts: text, tokens, code as in :class:`Boundaries`. Parts are words of the pattern, or runs of tokens of a
    long word that end with a character. Any run of neighbouring tokens is the encoding of its text, so the counts stay exact."""
    out: list[tuple[str, int, int]] = []
    lead, lead_n = "", 0
    for word in enc.split(chunk):
        packed = enc.words[word]
        if len(packed) <= 4 * ATOM:
            parts = [(word, len(packed) // 4)]
        else:
            ids = np.frombuffer(packed, "<i4")
            data, parts, held, n = word.encode("utf-8", "replace"), [], 0, 0
            ends = np.cumsum([enc.words.length[i] for i in ids.tolist()])
            for end in ends.tolist():
                n += 1
                # A word of signs has no letters, so that only its last sign, if an apostrophe, could begin a contraction.
                whole = end == len(data) or (data[end] & 0xC0) != 0x80 and (data[end] != 0x27 or end < len(data) - 1)
                if whole and (n >= ATOM // 2 or end == len(data)):
                    parts.append((data[held:end].decode("utf-8"), n))
                    held, n = end, 0
        blank = word.isspace()
        for k, (text, n) in enumerate(parts):
            if blank and k == len(parts) - 1:
                lead, lead_n = lead + text, lead_n + n  # the last blanks stay with what follows
                continue
            ended = bool(out) and out[-1][2] >= 8 and k == 0
            out.append((lead + text, lead_n + n, (3 if ended else 5) + 8 * ends_sentence(text)))
            lead, lead_n = "", 0
    if lead:
        out.append((lead, lead_n, 5))
    return out


def cuts(enc: Encoder, kinds: Boundaries, chunks: list[str], counts: np.ndarray, limit: int, overlap: int) -> dict[str, np.ndarray]:
    """The boundaries of a text that may become cuts: at, start (of the piece that follows, in characters), their token counts,
    kind, and next: the position of the farthest legal successor in these arrays."""
    lens = np.fromiter(map(len, chunks), "i8", len(chunks))
    codes = np.fromiter(map(kinds.__getitem__, chunks), "i8", len(chunks))
    long = np.flatnonzero(counts > ATOM)
    if len(long):
        pieces, begun = [], 0
        for i in long.tolist():
            a = atoms(enc, chunks[i])
            first = int(codes[i]) & 7
            pieces += [(lens[begun:i], counts[begun:i], codes[begun:i]), (np.array([len(x[0]) for x in a]), np.array([x[1] for x in a]), np.array([first + (a[0][2] & 8)] + [x[2] for x in a[1:]]))]
            begun = i + 1
        pieces.append((lens[begun:], counts[begun:], codes[begun:]))
        lens, counts, codes = (np.concatenate([p[k] for p in pieces]).astype("i8") for k in range(3))
    n = len(lens)
    at, tokens = np.zeros(n + 1, "i8"), np.zeros(n + 1, "i8")
    np.cumsum(lens, out=at[1:])
    np.cumsum(counts, out=tokens[1:])
    kind = np.zeros(n + 1, "i8")
    kind[:n] = codes & 7
    ended = np.concatenate([[False], codes >= 8])
    kind[(kind == 4) & ended] = 3
    kind[0] = kind[n] = 0
    keep = kind <= 3
    natural = np.flatnonzero(keep)
    wide = np.flatnonzero(np.diff(tokens[natural]) > (limit - overlap) // 2)
    for w in wide.tolist():
        keep[natural[w] : natural[w + 1]] = True
    c = np.flatnonzero(keep)
    start = np.minimum(np.searchsorted(tokens, tokens[c] - overlap, "left"), c)
    start[0] = 0
    reach = tokens[start] + limit
    place = np.arange(len(c))
    nxt = np.searchsorted(tokens[c], reach, "right") - 1
    done = nxt == len(c) - 1
    for k in (3, 2, 1, 0):  # a stronger kind overrides
        ck = np.flatnonzero(kind[c] <= k)
        e = ck[np.searchsorted(tokens[c[ck]], reach, "right") - 1]
        good = ~done & (e > place) & (tokens[c[e]] - tokens[start] >= FILL * limit)
        nxt = np.where(good, e, nxt)
    nxt = np.where(place == len(c) - 1, place, np.maximum(nxt, np.minimum(place + 1, len(c) - 1)))
    return {"at": at[c], "start": at[start], "at_tokens": tokens[c], "start_tokens": tokens[start], "kind": kind[c], "next": nxt}


FIELDS = ["at", "start", "at_tokens", "start_tokens", "kind", "next"]


def successors(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text, and the boundary arrays of :func:`cuts` for every text that isn't null or empty. A narrow map."""
    if not 0 <= overlap <= limit // 4 or limit < 4 * ATOM:
        raise ValueError(f"limit must be at least {4 * ATOM} tokens and overlap at most a quarter of it")
    path = os.path.join(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kinds = encoder(path), Boundaries()
        for batch in batches:
            cols: dict[str, list] = {f: [] for f in FIELDS}
            sizes = []
            for text in batch.column("text").to_pylist():
                chunks = CHUNK.findall(text)
                counts = np.fromiter(map(len, map(enc.__getitem__, chunks)), "i8", len(chunks)) // 4
                total = int(counts.sum())
                if total <= limit:
                    found = {"at": [0, len(text)], "start": [0, len(text)], "at_tokens": [0, total], "start_tokens": [0, total], "kind": [0, 0], "next": [1, 1]}
                else:
                    found = cuts(enc, kinds, chunks, counts, limit, overlap)
                sizes.append(len(found["at"]))
                for f in FIELDS:
                    cols[f].append(np.asarray(found[f], "i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(cols[f]) if cols[f] else np.zeros(0, "i4"))) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *lists], names=["doc_id", "text", *FIELDS])

    schema = "doc_id bigint, text string, " + ", ".join(f"`{f}` array<int>" for f in FIELDS)
    return documents.select("doc_id", "text").where("text <> ''").mapInArrow(run, schema)


def split(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, piece, first_char, n_tokens, ends_at, text: the pieces of every text of ``documents`` (doc_id, text), counted from 0.

    n_tokens is at most ``limit`` and is what encoding the piece by itself gives. A piece after the first begins up to ``overlap``
    tokens before the cut, at a word; without that the pieces are the text, character by character. ends_at is the kind of the cut
    at its end: part, paragraph, line, sentence, and, where none of these leaves the piece half full, word or inside a word. A text
    within the limit is one piece. Null and empty texts give none; texts of any length are cut whole.
    """
    s = successors(documents, limit, overlap, tokenizer, folder)
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("next"))).cast("int"))
    jump = lambda table, i: F.get(table, i)
    known = F.aggregate(
        rounds,
        F.struct(F.array(F.lit(0)).alias("made"), F.col("next").alias("leap")),
        lambda a, _: F.struct(
            F.array_distinct(F.concat(a["made"], F.transform(a["made"], lambda i: jump(a["leap"], i)))).alias("made"),
            F.transform(a["leap"], lambda i: jump(a["leap"], i)).alias("leap"),
        ),
        lambda a: F.array_sort(a["made"]),
    )
    s = s.withColumn("made", known)
    piece = F.transform(
        F.slice("made", F.lit(2), F.size("made") - 1),
        lambda c, k: F.struct(
            k.alias("piece"), F.get("start", F.get("made", k)).alias("first_char"), F.get("at", c).alias("end"),
            (F.get("at_tokens", c) - F.get("start_tokens", F.get("made", k))).alias("n_tokens"), F.get(F.array(*map(F.lit, KINDS)), F.get("kind", c)).alias("ends_at"),
        ),
    )
    s = s.select("doc_id", "text", F.explode(piece).alias("p"))
    return s.select("doc_id", "p.piece", "p.first_char", "p.n_tokens", "p.ends_at", F.substring("text", F.col("p.first_char") + 1, F.col("p.end") - F.col("p.first_char")).alias("text"))
