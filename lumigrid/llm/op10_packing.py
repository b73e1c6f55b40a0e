"""Packing along a space-filling curve.

A document's hashed vector (runs of four bytes) is projected to four dimensions, each mapped to 8 bits, and turned into
its Hilbert key; 21 bits of a hash of the row's place in its input partition follow, so that equal documents, which have equal keys,
can be dealt to several ranges, also rows that repeat a doc_id or have none. Ranges of about equal bytes come from approximate
quantiles of the keys, each counted by its text's length, lines between them if there are more; their number grows with the bytes of the texts. One exchange brings the token
ids of a range together in a partition of its own; sorted by key they are cut at each
multiple of the length, so neighbours on the curve share sequences and no token is padding. The rest
of a range is cut into sequences whose lengths are powers of two, which need no padding either.

Defined results: a null text is empty and has only the end id. Repeated rows are packed one by one. A
null doc_id is kept. Very long texts are encoded whole and cut freely. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import itertools
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import places, range_count, small_batches, table

LENGTH = 4096
END = 2
DIMENSIONS, BITS, SALT = 4, 8, 21
#: Steps of the keys' distribution that the driver gets.
QUANTILES = 1000
#: A text's key counts once in that distribution for so many characters, and a row is taken to need ROW besides: ranges are alike in bytes.
WEIGHT, ROW = 1024, 64
_BUCKET_BITS = 10
_BUCKETS = 1 << _BUCKET_BITS
_GRAM = (hashing.stream(9, 4) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
#: Chunks and words whose ids a Python worker remembers.
CHUNKS, WORDS = 250_000, 500_000
#: What str.split() takes for white space and the tokenizer's patterns do not.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[^\\S\x1c-\x1f]+")
#: The vocabulary's own split, for lower-case text of code points below 256. Fixed values.
_WORD = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


def hilbert(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points with integer coordinates below 2**bits (rows)."""
    x = coordinates.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    level = np.uint64(1 << (bits - 1))
    while level > one:
        low = level - one
        for i in range(n):
            hit = (x[i] & level) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    level = np.uint64(1 << (bits - 1))
    while level > one:
        turn = np.where((x[n - 1] & level) != 0, turn ^ (level - one), turn)
        level >>= one
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def vectors(texts: list[str | None]) -> np.ndarray:
    """Counts of each text's hashed runs of four bytes, scaled to length 1."""
    out = np.zeros((len(texts), _BUCKETS))
    for k, text in enumerate(texts):
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16)
        if len(b) >= 4:
            h = (b[:-3] * _GRAM[0] + b[1:-2] * _GRAM[1] + b[2:-1] * _GRAM[2] + b[3:] * _GRAM[3]) >> np.uint16(16 - _BUCKET_BITS)
            out[k] = np.bincount(h, minlength=_BUCKETS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


def keys(places: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Sort keys: the Hilbert key, then bits of the hash of each row's place."""
    turn = (hashing.stream(5, _BUCKETS * DIMENSIONS).reshape(_BUCKETS, DIMENSIONS) >> np.uint64(63)).astype(np.float64) * 2 - 1
    spread = vectors(texts) @ turn  # of variance 1 over random turns
    share = 1 / (1 + np.exp(-1.702 * spread))
    point = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    salt = hashing.mix(places) >> np.uint64(64 - SALT)
    return ((hilbert(point) << np.uint64(SALT)) | salt).astype(np.int64)


def _placed(frames):
    """Each frame with its rows' places: the partition's number and the position there, alike when a task runs again."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for frame in frames:
        yield frame, np.arange(at, at + len(frame), dtype=np.uint64)
        at += len(frame)


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _plain(text: str) -> bool:
    """Whether case can be dropped beforehand: code points below 256 only, and no special token."""
    if "<|" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of whole texts.

    The vocabulary drops case and white space and ends its words there, so chunks between white space
    are independent. Chunks met before are remembered; new ones are cut into words, and the
    tokenizer encodes the words not met before, many at a time: each word's last id is marked.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.last = np.zeros(size, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _alone(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        made = {}
        for a in range(0, len(words), 512):
            part = words[a : a + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, w = ids.tobytes(), self.kind.itemsize
                cut = (ends * w).tolist()
                made.update(zip(part, (raw[x:y] for x, y in zip([0, *cut], cut))))
            else:
                made.update((x, self._alone(x)) for x in part)
        return made

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text, without the end id."""
        cut, found, new = [], [], {}
        get = self.chunks.get
        for t in texts:
            t = t or ""
            if _plain(t):
                t = t.lower()
            chunks = _SPACE.split(t) if _ODD.search(t) else t.split()
            ids = list(map(get, chunks))
            if None in ids:
                new.update((c, None) for c, x in zip(chunks, ids) if x is None)
            cut.append(chunks)
            found.append(ids)
        made = self._made(list(new))
        for chunks, ids in zip(cut, found):
            if None in ids:
                ids[:] = [made[c] if x is None else x for c, x in zip(chunks, ids)]
        return [b"".join(ids) for ids in found]

    def _made(self, chunks: list[str]) -> dict[str, bytes]:
        parts = [_WORD.findall(c.lower()) if _plain(c) else None for c in chunks]
        words = self.words
        fresh = self._encoded(list({w: None for x in parts if x for w in x if w not in words}))
        words.update(itertools.islice(fresh.items(), max(0, WORDS - len(words))))
        made = {
            c: self._alone(c) if x is None else b"".join([fresh[w] if w in fresh else words[w] for w in x]) for c, x in zip(chunks, parts)
        }
        self.chunks.update(itertools.islice(made.items(), max(0, CHUNKS - len(self.chunks))))
        return made


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def tail_lengths(n: int) -> list[int]:
    """Powers of two, falling, with sum ``n``."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """Cuts the ids of one range, one document after another."""

    def __init__(self, bucket: int, length: int):
        self.sequence, self.length = bucket << 32, length
        self.open: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.held = 0
        self.out: list[tuple] = []

    def _emit(self) -> None:
        offset = 0
        for doc, start, ids, total in self.open:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.open, self.held = [], 0

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None, length: int | None = None) -> None:
        total, at = len(ids) if total is None else total, 0
        length = length or self.length
        while at < len(ids):
            take = min(length - self.held, len(ids) - at)
            self.open.append((doc, start + at, ids[at : at + take], total))
            self.held += take
            at += take
            if self.held == length:
                self._emit()

    def close(self) -> None:
        rest, lengths = self.open, tail_lengths(self.held)
        self.open, self.held = [], 0
        for doc, start, ids, total in rest:
            at = 0
            while at < len(ids):
                take = min(lengths[0] - self.held, len(ids) - at)
                self.add(doc, ids[at : at + take], start + at, total, lengths[0])
                at += take
                if not self.held:
                    lengths.pop(0)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, ranges: int | None = None) -> DataFrame:
    """One row for each piece of a document: see the module's text."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def key_only(frames):
        for frame, place in _placed(frames):
            texts = frame["text"].tolist()
            size = np.array([len(t or "") for t in texts], np.int64)
            # Rounded up or down by a hash, so that many short texts count right too.
            copies = (size + ROW + (hashing.mix(place) % np.uint64(WEIGHT)).astype(np.int64)) // WEIGHT
            yield pd.DataFrame({"key": np.repeat(keys(place, texts), copies), "size": 0})
            yield pd.DataFrame({"key": pd.array([None], "Int64"), "size": [size.sum()]})

    share = F.array(*[F.lit(k / QUANTILES) for k in range(QUANTILES + 1)])
    found = source.mapInPandas(key_only, "key long, size long").agg(F.percentile_approx("key", share, F.lit(20 * QUANTILES)), F.sum("size")).first()
    ranges = ranges or range_count(spark, found[1])
    edges = np.interp(np.arange(1, ranges) / ranges, np.linspace(0, 1, QUANTILES + 1), found[0] or [0] * (QUANTILES + 1)).astype(np.int64)
    place_of = np.array(places(spark, ranges), np.int32)

    def encode(frames):
        encoder = _encoder(tokenizer)
        gc.disable()  # nothing here makes cycles, and the caches are costly to traverse
        try:
            for frame, place in _placed(frames):
                texts = frame["text"].tolist()
                key = keys(place, texts)
                last = np.array([end], encoder.kind).tobytes()
                bucket = np.searchsorted(edges, key, side="right").astype(np.int32)
                yield pd.DataFrame(
                    {
                        "place": place_of[bucket],
                        "bucket": bucket,
                        "key": key,
                        "doc_id": frame["doc_id"].astype("Int64"),
                        "wide": encoder.kind.itemsize == 4,
                        "ids": [x + last for x in encoder.ids(texts)],
                    }
                )
        finally:
            gc.enable()

    def cut(frames):
        packer, bucket = None, None
        names = [x.split()[0] for x in _PIECE.split(", ")]

        def made(out):
            frame = pd.DataFrame(out, columns=names)
            return frame.astype({"doc_id": "Int64"})

        for frame in frames:
            for b, doc, wide, ids in zip(frame["bucket"], frame["doc_id"], frame["wide"], frame["ids"]):
                if b != bucket:
                    if packer:
                        packer.close()
                        yield made(packer.out)
                    packer, bucket = _Packer(int(b), length), b
                packer.add(None if pd.isna(doc) else int(doc), np.frombuffer(ids, "<u4" if wide else "<u2"))
            if packer and packer.out:
                yield made(packer.out)
                packer.out = []
        if packer:
            packer.close()
            yield made(packer.out)

    coded = source.mapInPandas(encode, "place int, bucket int, key long, doc_id long, wide boolean, ids binary")
    # Every field takes part in the order: a run after a lost executor cuts alike.
    return coded.repartition(ranges, "place").sortWithinPartitions("bucket", "key", "doc_id", "ids").mapInPandas(cut, _PIECE)


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
