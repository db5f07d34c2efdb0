"""Packing documents into sequences of at most `size` tokens: shortest-pack-first over the histogram of lengths.

Every document's ids are cut into pieces of `size` and one rest.  The histogram of piece lengths (at most `size` numbers) goes to the driver,
where lengths are placed longest first, each into the emptiest pack that has room, as counts of packing patterns, never single packs.
Each pattern holds a run of ranks of each length; pieces get their rank among pieces of their length and look their pattern up.

Defined results: a null text is empty; a document always has the closing id, so an empty one is one piece of length 1; repeated rows are packed like
other documents; ties in rank are broken by doc_id and start; a null doc_id is packed too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, documents, lean, ranked, stored, tidy, word_hashes
from .windows import packed_words

SIZE = 2048
CLOSE = 1
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Distinct words whose ids a task remembers, at most; then those met in one group of texts only are forgotten.
REMEMBER = 600_000
#: A word that can't be encoded by itself holds other white space.
_ODD = re.compile(r"\s")
_AWKWARD = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"<|")


def vocabulary() -> tuple[str, str]:
    """The tokenizer and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, by the tokenizer file at `path`.

    Byte-level BPE never merges across a single blank before a word or a single line end, so each distinct word (with what is before it) is encoded once and remembered by its hash (its bytes are compared on every hit, and a text with a word that differs is encoded whole); a
    group of texts is looked up and put together in numpy.  With `ranks` (the same vocabulary as a list of ranks) new words are encoded by the faster library that reads it; the
    ids are the same.  Texts with other white space or special tokens are encoded whole.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.model, self.quick = Tokenizer.from_file(path), None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.line = self.model.encode("\n", add_special_tokens=False).ids
        self.known: dict[int, int] = {}  # hash of a word and what is before it -> its place below
        self.pool, self.used, self.odd = np.zeros(1 << 16, np.uint32), 0, set()
        self.words: list[bytes] = []
        # Of each word: where its ids are in the pool, how many, in how many groups of texts it was met, and its hash.
        self.first, self.size, self.met, self.key = (np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.uint64))

    def forget(self) -> None:
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > REMEMBER // 2:
            keep = keep[:0]
        size = self.size[keep]
        at = np.cumsum(size) - size
        ids = self.pool[np.repeat(self.first[keep] - at, size) + np.arange(int(size.sum()))]
        odd = {int(i) for i in np.flatnonzero(np.isin(keep, list(self.odd)))} if self.odd else set()
        self.pool, self.used, self.odd = np.concatenate((ids, np.zeros(1 << 16, np.uint32))), len(ids), odd
        self.first, self.size, self.met, self.key = at, size, np.ones(len(keep), np.int32), self.key[keep]
        self.known = dict(zip(self.key.tolist(), range(len(keep)), strict=True))
        self.words = [self.words[i] for i in keep.tolist()]

    def whole(self, text: bytes) -> bytes:
        return np.array(self.model.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, keys: np.ndarray, words: list[bytes], before: list[int]) -> None:
        """New words; before: 0 start of text, 1 a blank, 2 a line end."""
        found, base = [], len(self.first)
        single = self.quick._core_bpe.encode_single_piece if self.quick else None
        for i, (word, b) in enumerate(zip(words, before, strict=True)):
            text = word.decode("utf-8", "replace")
            if single and text.isalpha():  # one piece for the model, so no need to split it
                ids = single(b" " + word if b == 1 else word)
            else:
                if _ODD.search(text):
                    self.odd.add(base + i)
                text = " " + text if b == 1 else text
                ids = self.quick.encode_ordinary(text) if self.quick else self.model.encode(text, add_special_tokens=False).ids
            found.append(self.line + ids if b == 2 else ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        n = self.used + int(size.sum())
        if n > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(n, len(self.pool)), np.uint32)))
        self.pool[self.used : n] = np.fromiter(chain.from_iterable(found), np.uint32, n - self.used)
        self.known.update(zip(keys.tolist(), range(base, base + len(found)), strict=True))
        self.first = np.concatenate((self.first, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.met = np.concatenate((self.met, np.zeros(len(found), np.int32)))
        self.key = np.concatenate((self.key, keys))
        self.words += words
        self.used = n

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if t[0] in b" \n" or t[-1] in b" \n" or any(x in t for x in _AWKWARD):
                out[i] = self.whole(t)
            else:
                plain.append(i)
        if not plain:
            return out
        if len(self.known) > REMEMBER:
            self.forget()
        buffer = b"\n".join([texts[i] for i in plain]) + b"\n"
        a = np.frombuffer(buffer, np.uint8)
        h, start, end = word_hashes(a)
        stops = np.cumsum([len(texts[i]) + 1 for i in plain])
        of = np.searchsorted(start, np.concatenate(([0], stops)))
        before = np.where(a[start - 1] == 32, 1, 2)
        before[of[:-1]] = 0
        key = h ^ (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((end - start).astype(np.uint64) << np.uint64(40))
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.fromiter(map(self.known.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        bad = ~_alike(buffer, start, end, where[back])
        wrong = [i for i, p, x, y in zip(range(len(place)), place.tolist(), start[where].tolist(), end[where].tolist(), strict=True) if p >= 0 and self.words[p] != buffer[x:y]]
        if wrong:
            bad |= np.isin(back, wrong)
        if len(new):
            place[new] = np.arange(len(self.first), len(self.first) + len(new))
            w = where[new]
            self.learn(distinct[new], [buffer[x:y] for x, y in zip(start[w].tolist(), end[w].tolist(), strict=True)], before[w].tolist())
        self.met[place] += 1
        size, first = self.size[place][back], self.first[place][back]
        at = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(first - at[:-1], size) + np.arange(at[-1])].astype("<u4").tobytes()
        cuts = (4 * at[of]).tolist()
        for i, x, y in zip(plain, cuts, cuts[1:]):
            out[i] = ids[x:y]
        if self.odd:
            bad |= np.fromiter((p in self.odd for p in place.tolist()), bool, len(place))[back]
        if bad.any():
            for i in np.unique(np.searchsorted(of, np.flatnonzero(bad), side="right") - 1).tolist():
                out[plain[i]] = self.whole(texts[plain[i]])
        return out


def _alike(buffer: bytes, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of another of the same length (by its number), eight bytes at a time."""
    words, size = packed_words(buffer), end - start
    short = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    ok = size == size[other]
    ok &= (words[start] >> short) == (words[start[other]] >> short)
    at, left = 8, np.flatnonzero(ok & (size > 8))
    while len(left):
        off = np.minimum(at, size[left] - 8)
        ok[left] = words[start[left] + off] == words[start[other[left]] + off]
        at += 8
        left = left[size[left] > at]
    return ok


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, ranks: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    lean(docs.sparkSession)
    if path is None:
        path, ranks = vocabulary()

    def run(batches):
        encoder = None
        for b in batches:
            encoder = Encoder(path, ranks) if encoder is None else encoder
            rows = []
            for a, z in batches_of(b.column(1), 1 << 21):
                for d, raw in zip(b.column(0).slice(a, z - a).to_pylist(), encoder.encode(b.column(1).slice(a, z - a).to_pylist()), strict=True):
                    raw += CLOSE.to_bytes(4, "little")
                    n = len(raw) // 4
                    rows += [(d, s, min(size, n - s), zlib.crc32(raw[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder = None
        tidy()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, PIECES)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and their counts."""
    room: dict[int, list[list]] = {}  # space left -> [pattern, count], any number of them
    spaces: list[int] = []  # those in use, sorted
    import bisect

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(spaces, space)
        room[space].append([pattern, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not spaces or spaces[-1] < length:  # no pack has room: open new ones, each as full of this length as it gets
                each = max(1, min(left, size // length))
                n = left // each
                put(size - each * length, (length,) * each, n)
                left -= each * n
                continue
            space = spaces[-1]
            pattern, n = room[space].pop()
            used = min(n, left)
            if n > used:
                room[space].append([pattern, n - used])
            if not room[space]:
                del room[space]
                spaces.pop()
            put(space - length, (*pattern, length), used)
            left -= used
    return [(p, n) for _, them in sorted(room.items()) for p, n in them]


def places(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """length, first rank, count, first sequence, offset of each place in each pattern, by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in found:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    spark = docs.sparkSession
    # Stored first: a range shuffle reads its input twice, and nothing should be encoded twice.
    cut = stored(pieces(docs, path, size), "encoded")
    kept = ranked(cut, ["length", "doc_id", "start", "ids_crc32"], "pieces", within="length")
    # One row for each length, `size` at most.
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(patterns(histogram, size)))

    def place(batches):
        t = table.value
        key = (t[:, 0] << 40) + t[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (2, 5))
            row = t[np.searchsorted(key, (length << 40) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(np.ascontiguousarray(row[:, 4]))], names=[*b.schema.names[:5], "sequence_id", "offset"]
            )

    return kept.mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


SQL = None
