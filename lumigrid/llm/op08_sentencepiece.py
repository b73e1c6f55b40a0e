"""Unigram encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

The vocabulary is read from a model file and never trained. Its own numbers are merge ranks; a piece
of rank r gets the log score ``-log(r + 3)``, a Zipf law, so that frequent pieces are likely and each
further piece costs. A text gets the whitespace marker in front and for each space; the segmentation
of the largest sum of scores is found by Viterbi. Characters that no piece covers are spelled in byte
pieces. As no piece holds a marker after another character, or a newline, a text falls into chunks
there that are segmented one by one and remembered. Ties go to the longer last piece.

Decoding joins the pieces and bytes, turns markers into spaces and drops the first: every text comes
back as it was, a marker character in a text too, as that is spelled in bytes.

Defined results: null and empty texts have no ids and decode to an empty text. Repeated rows are
encoded one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MARK = "▁"
_CHUNK = re.compile(r" +[^ \n]*|\n+|[^ \n]+")
#: Chunks a Python worker remembers, and the longest (bytes) of those that share array work.
CACHE, SHORT = 600_000, 48
_BYTE_SCORE = -25.0


class DoubleArray:
    """A trie over bytes in two arrays: a child by byte c of state s is t = base[s] + c with check[t] = s."""

    def __init__(self, words: list[bytes]):
        order = sorted(range(len(words)), key=words.__getitem__)
        size = 1 << 12
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        todo = [(0, 0, len(order), 0)]  # state, range of sorted words, depth
        low, window = 1, 4096  # bases are sought from here on
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(words[order[lo]]) == depth:
                value[state] = order[lo]
                lo += 1
            if lo == hi:
                continue
            kids, at = [], lo
            while at < hi:
                c = words[order[at]][depth]
                end = at
                while end < hi and words[order[end]][depth] == c:
                    end += 1
                kids.append((c, at, end))
                at = end
            codes = np.array([k[0] for k in kids])
            from_ = low
            while True:
                while from_ + window + 256 >= len(check):
                    base = np.concatenate([base, np.zeros(len(base), np.int32)])
                    value = np.concatenate([value, np.full(len(check), -1, np.int32)])
                    check = np.concatenate([check, np.full(len(check), -1, np.int32)])
                free = check[from_ : from_ + window + 256] < 0
                fits = free[codes[0] : codes[0] + window].copy()
                for c in codes[1:]:
                    fits &= free[c : c + window]
                if fits.any():
                    b = from_ + int(fits.argmax())
                    break
                from_ += window
            if from_ > low and np.count_nonzero(check[low : low + window] < 0) < window // 16:
                low += window
            base[state] = b
            check[b + codes] = state
            for c, x, y in kids:
                todo.append((b + c, x, y, depth + 1))
        used = int(np.flatnonzero(check >= 0)[-1]) + 257
        pad = max(0, used - len(check))
        self.base = np.concatenate([base, np.zeros(pad, np.int32)])[:used]
        self.check = np.concatenate([check, np.full(pad, -1, np.int32)])[:used]
        self.value = np.concatenate([value, np.full(pad, -1, np.int32)])[:used]
        self.depth = max(map(len, words))

    def get(self, word: bytes) -> int:
        s = 0
        for c in word:
            t = int(self.base[s]) + c
            if not self.base[s] or self.check[t] != s:
                return -1
            s = t
        return int(self.value[s])


class Model:
    """Pieces as bytes (marker as a space), their log scores, the trie, and the ids of byte pieces."""

    def __init__(self, pieces: list[str], ranks: list[float], byte_ids: list[int]):
        self.size = len(pieces)
        special = set(byte_ids)
        self.byte_ids = np.array(byte_ids, np.int64)
        self.surface = [b""] * len(pieces)
        for b, i in enumerate(byte_ids):
            self.surface[i] = bytes([b])
        real = [i for i, p in enumerate(pieces) if i not in special and math.isfinite(ranks[i])]
        for i in real:
            self.surface[i] = pieces[i].replace(MARK, " ").encode()
        self.ids = np.array(real, np.int64)
        self.score = np.array([-math.log(ranks[i] + 3) for i in real])
        self.trie = DoubleArray([self.surface[i] for i in real])
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        pieces = [p.id_to_piece(i) for i in range(n)]
        bytes_at = {pieces[i]: i for i in range(n) if p.is_byte(i)}
        byte_ids = [bytes_at[f"<0x{b:02X}>"] for b in range(256)]
        first = max(byte_ids) + 1
        ranks = [math.inf if p.is_unknown(i) or p.is_control(i) or p.is_byte(i) else max(0, i - first) for i in range(n)]
        return cls(pieces, ranks, byte_ids)


def viterbi(model: Model, chunk: bytes) -> list[int]:
    """The best ids of one chunk; the plain form of the algorithm, linear in the chunk's length."""
    base, check, value, score = model.trie.base, model.trie.check, model.trie.value, model.score
    n = len(chunk)
    best, back = [-math.inf] * (n + 1), [(-1, -1)] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if chunk[i] & 0xC0 == 0x80:
            continue
        width = 1
        while i + width < n and chunk[i + width] & 0xC0 == 0x80:
            width += 1
        s, single = 0, False
        for j in range(i, n):
            t = base[s] + chunk[j]
            if check[t] != s or not t:
                break
            s = t
            if value[s] >= 0:
                v = best[i] + score[value[s]]
                single |= j + 1 - i == width
                if v > best[j + 1]:
                    best[j + 1], back[j + 1] = v, (i, int(model.ids[value[s]]))
        if not single:
            v = best[i] + _BYTE_SCORE
            if v > best[i + width]:
                best[i + width], back[i + width] = v, (i, -1)
    out, end = [], n
    while end:
        start, piece = back[end]
        out.append([piece] if piece >= 0 else [int(model.byte_ids[b]) for b in chunk[start:end]])
        end = start
    return [i for part in reversed(out) for i in part]


def viterbi_many(model: Model, chunks: list[bytes]) -> list[list[int]]:
    """The same for many short chunks at once, one array step for each start and piece length."""
    trie, n = model.trie, len(chunks)
    length = np.array([len(c) for c in chunks])
    most = int(length.max(initial=0))
    data = np.zeros((n, most), np.uint8)
    data[np.arange(most)[None, :] < length[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
    lead = (data & 0xC0) != 0x80
    best = np.full((n, most + 1), -np.inf)
    best[:, 0] = 0
    start, piece = np.zeros((n, most + 1), np.int32), np.full((n, most + 1), -1, np.int32)
    for i in range(most):
        rows = np.flatnonzero((length > i) & lead[:, i])
        if not len(rows):
            continue
        width = np.ones(len(rows), np.int64)
        for k in range(1, 4):
            if i + k < most:
                width += (width == k) & (length[rows] > i + k) & ~lead[rows, i + k]
        single = np.zeros(len(rows), bool)
        state, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for j in range(i, min(most, i + trie.depth)):
            live = live[length[rows[live]] > j]
            if not len(live):
                break
            r = rows[live]
            t = trie.base[state[live]] + data[r, j]
            ok = (trie.check[t] == state[live]) & (t > 0)
            live, t = live[ok], t[ok]
            if not len(live):
                break
            state[live] = t
            v = trie.value[t]
            hit = v >= 0
            at, v = live[hit], v[hit]
            r = rows[at]
            single[at] |= width[at] == j + 1 - i
            total = best[r, i] + model.score[v]
            better = total > best[r, j + 1]
            r, at, v = r[better], at[better], v[better]
            best[r, j + 1], start[r, j + 1], piece[r, j + 1] = total[better], i, v
        at = np.flatnonzero(~single)
        r, end = rows[at], i + width[at]
        total = best[r, i] + _BYTE_SCORE
        better = total > best[r, end]
        r, end = r[better], end[better]
        best[r, end], start[r, end], piece[r, end] = total[better], i, -1
    # Walk back for all chunks at once, from the last piece to the first.
    made: list[list[list[int]]] = [[] for _ in range(n)]
    end, live = length.copy(), np.flatnonzero(length > 0)
    ids = model.ids
    while len(live):
        s, p = start[live, end[live]], piece[live, end[live]]
        for k, a, b, i in zip(live.tolist(), s.tolist(), end[live].tolist(), np.where(p >= 0, ids[p], -1).tolist()):
            made[k].append([i] if i >= 0 else [int(x) for x in model.byte_ids[data[k, a:b]]])
        end[live] = s
        live = live[s > 0]
    return [[i for part in reversed(parts) for i in part] for parts in made]


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {}

    def _made(self, chunks: list[str]) -> dict[str, bytes]:
        coded = [c.encode("utf-8", "surrogatepass") for c in chunks]
        order = sorted(range(len(chunks)), key=lambda k: len(coded[k]))
        made: dict[str, bytes] = {}
        kind = self.model.kind
        for a in range(0, len(order), 8192):
            part = order[a : a + 8192]
            short = [k for k in part if len(coded[k]) <= SHORT]
            for k, ids in zip(short, viterbi_many(self.model, [coded[k] for k in short]) if short else []):
                made[chunks[k]] = np.array(ids, kind).tobytes()
            for k in part[len(short) :]:
                made[chunks[k]] = np.array(viterbi(self.model, coded[k]), kind).tobytes()
        self.known.update(itertools.islice(made.items(), max(0, CACHE - len(self.known))))
        return made

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        cut, found, new = [], [], {}
        get = self.known.get
        for t in texts:
            chunks = _CHUNK.findall(" " + t) if t else []
            ids = list(map(get, chunks))
            if None in ids:
                new.update((c, None) for c, x in zip(chunks, ids) if x is None)
            cut.append(chunks)
            found.append(ids)
        made = self._made(list(new)) if new else {}
        for chunks, ids in zip(cut, found):
            if None in ids:
                ids[:] = [made[c] if x is None else x for c, x in zip(chunks, ids)]
        return [b"".join(ids) for ids in found]

    def decode(self, packed: bytes) -> str:
        surface = self.model.surface
        raw = b"".join([surface[i] for i in np.frombuffer(packed, self.model.kind).tolist()])
        return raw[1:].decode("utf-8", "surrogatepass")


@functools.cache
def _codec(path: str) -> Codec:
    """One for all tasks of a Python worker."""
    return Codec(Model.load(path))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text, ids (packed little-endian, two bytes each, four for over 65,536 pieces), n_tokens, decoded."""
    small_batches(docs.sparkSession, 500)
    if model is None:
        import public_tokenizers

        model = str(public_tokenizers.path("piece_bpe_32k.model"))

    def run(frames):
        codec = _codec(model)
        width = codec.model.kind.itemsize
        gc.disable()  # nothing here makes cycles, and the cache is costly to traverse
        try:
            for frame in frames:
                ids = codec.encode(frame["text"].tolist())
                made = {"doc_id": frame["doc_id"].astype("Int64"), "text": frame["text"], "ids": ids, "n_tokens": [len(x) // width for x in ids]}
                yield pd.DataFrame(made | {"decoded": [codec.decode(x) for x in ids]})
        finally:
            gc.enable()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInPandas(run, "doc_id long, text string, ids binary, n_tokens long, decoded string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number and CRC of the ids, digest of the decoded text, and whether it is the text."""
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
