"""Super-k-mer partitioning: all windows of k units, brought together by minimiser and compared exactly.

A unit is a byte or a word.  Consecutive windows with the same minimiser (the smallest hash of the m-unit grams
inside) travel as one packed string to the minimiser's bucket; equal windows have equal minimisers, so they meet
there.  A gram that a sample shows in many documents is taken as a minimiser only where a window holds nothing
else, and such a window goes to a bucket of its own hash, so no common passage fills one bucket.  Strings that repeat
within a batch are decided on the spot and sent once.  Windows of words are ordered by 64-bit hashes and compared on the text itself; windows of bytes are ordered by their bytes, in a
suffix array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TABLE, batches_of, grams, mix, partitions_for, prefix, slices, tidy, word_hashes

U = np.uint64
TOP = U(1 << 63)
BUCKET_SCHEMA = "bucket int, n int, text binary, meta binary, sure int"
SPAN_SCHEMA = "doc_id bigint, tag bigint, spans binary"
#: Bytes of text whose windows are cut at a time; bounds the memory of a task.
CHUNK = 1 << 21


@dataclass
class Plan:
    """k: units in a window; m: units in a gram; words: units are words (else bytes); buckets: number of them."""

    k: int
    m: int
    words: bool
    buckets: int
    #: ordered: a window counts where an earlier document (smaller doc_id) has it; else where it starts anywhere else.
    ordered: bool
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, U))

    @property
    def chunk(self) -> int:
        """Bytes of text cut at a time: a byte as a unit needs more room than a word."""
        return CHUNK if self.words else CHUNK * 3 // 4


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < w:
        x = np.minimum(x[: len(x) - (w - have)], x[w - have :])
    return x


class Hot:
    """Membership in the hot grams: a bitmap passes nearly all others at once."""

    def __init__(self, hot: np.ndarray):
        self.hot, self.bits = np.sort(hot), np.zeros(1 << 20, bool)
        self.bits[(hot & U((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, g: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(g & U((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            maybe = maybe[self.hot[np.minimum(np.searchsorted(self.hot, g[maybe]), len(self.hot) - 1)] == g[maybe]]
        return maybe


def normal(b: bytes | None, words: bool) -> bytes:
    return b" ".join((b or b"").split()) if words else (b or b"")


def segments(b: bytes, k: int, words: bool, limit: int = CHUNK):
    """(first unit, bytes) of pieces that hold every window once; all but the last overlap the next by k - 1 units."""
    if len(b) <= limit:
        yield 0, b
    elif not words:
        for s in range(0, len(b), limit):
            yield s, b[s : s + limit + k - 1]
    else:
        at = unit = 0
        while at < len(b):
            cut = b.rfind(b" ", at, at + limit) if at + limit < len(b) else len(b)
            if cut <= at:
                cut = b.find(b" ", at)
                cut = len(b) if cut < 0 else cut
            end = cut
            for _ in range(k - 1):
                if end >= len(b):
                    break
                end = b.find(b" ", end + 1)
                end = len(b) if end < 0 else end
            yield unit, b[at:end]
            unit += b.count(b" ", at, cut) + 1
            at = cut + 1


def units(joined: np.ndarray, words: bool):
    """Value, first and last byte of each unit of bytes in which '\\n' ends every piece of words."""
    if words:
        return word_hashes(joined)
    return TABLE[joined], None, None  # byte i is unit i


def cut(pieces: list[bytes], plan: Plan, hot: Hot | None):
    """The super-k-mers of pieces: minimiser, piece, first window (unit of the piece), windows, first and last byte; and the buffer."""
    k, m = plan.k, plan.m
    buffer = b"\n".join(pieces) + b"\n" if plan.words else b"".join(pieces)
    joined = np.frombuffer(buffer, np.uint8)
    ends = np.cumsum([len(p) + plan.words for p in pieces])
    value, start, end = units(joined, plan.words)
    first = np.concatenate(([0], ends))
    if plan.words:
        first = np.searchsorted(start, first)
    n = len(value) - k + 1
    if n <= 0:
        return buffer, None
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(first))
    g = grams(value, m) >> U(1)
    if hot is not None:
        g[hot(g)] |= TOP
    least = sliding_min(g, k - m + 1)
    del g
    valid = piece[:n] == piece[k - 1 :]
    if hot is None:
        value = None
    all_hot = np.flatnonzero((least >= TOP) & valid)
    if len(all_hot):
        p = prefix(value)
        least[all_hot] = slices(p, all_hot, all_hot + k) | TOP
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | (piece[1:n] != piece[: n - 1])
    s = np.flatnonzero(new)
    if not len(s):
        return buffer, None
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    e = np.flatnonzero(stop)
    count = e - s + 1
    where = (start[s], end[e + k - 1]) if plan.words else (s, e + k)
    return buffer, (least[s], piece[s], s - first[piece[s]], count, *where)


def pack(arrays: list[np.ndarray]) -> bytes:
    import zstandard

    head = np.array([x for a in arrays for x in (a.dtype.num, len(a))], np.int64).tobytes()
    body = b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(len(arrays).to_bytes(4, "little") + head + body)


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.int64, np.uint64, np.int32, np.uint32, np.uint16, np.uint8, np.int8)}


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    m = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw, np.int64, 2 * m, 4)
    out, at = [], 4 + 16 * m
    for num, n in head.reshape(-1, 2).tolist():
        kind = _TYPES[num]
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)


def _settled(doc, tag, start, count, bucket) -> tuple:
    """Rows of windows that count for sure: they only pass through their bucket."""
    return bucket, len(doc), b"", pack([np.diff(doc, prepend=0), tag, start.astype(np.uint32), count.astype(np.uint32)]), 1


def deal(batches, plan: Plan):
    """Partition's rows (doc_id, tag, text bytes) -> packed super-k-mers by bucket."""
    import zstandard

    hot = Hot(plan.hot) if len(plan.hot) else None
    squeeze = zstandard.ZstdCompressor(level=3)
    turn = 0
    for batch in batches:
        ids, tags = (batch.column(i).to_pylist() for i in range(2))
        rows: list[tuple] = []
        for a, b in batches_of(batch.column(2), plan.chunk):
            pieces, owner, base = [], [], []
            for i, t in enumerate(batch.column(2).slice(a, b - a).to_pylist(), a):
                for u, piece in segments(normal(t, plan.words), plan.k, plan.words, plan.chunk):
                    pieces.append(piece)
                    owner.append(i)
                    base.append(u)
            whole = sum(map(len, pieces))
            step = max(1, len(pieces) if whole <= 2 * plan.chunk else 1)
            for at in range(0, len(pieces), step):
                part = pieces[at : at + step]
                buffer, found = cut(part, plan, hot)
                if found is None:
                    continue
                key, piece, start, count, first, last = found
                own = np.array(owner[at : at + step])[piece]
                doc = np.array(ids, np.int64)[own]
                tag = np.array(tags, np.int64)[own]
                start = start + np.array(base[at : at + step], np.int64)[piece]
                ship, many = _collapse(buffer, key, doc, first, last, plan)
                if ship is not None:
                    gone = np.flatnonzero(~ship | many)
                    o = gone[np.lexsort((start[gone], doc[gone]))]
                    turn += 1
                    rows.append(_settled(doc[o], tag[o], start[o], count[o], turn % plan.buckets))
                    keep = np.flatnonzero(ship)
                    key, doc, tag, start, count, first, last, many = (x[keep] for x in (key, doc, tag, start, count, first, last, many))
                bucket = (key % U(plan.buckets)).astype(np.int64)
                order = np.lexsort((start, doc, bucket))
                bounds = np.searchsorted(bucket[order], np.arange(plan.buckets + 1))
                f, l = first.tolist(), last.tolist()
                sep = b"\n" if plan.words else b""
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    o = order[bounds[k] : bounds[k + 1]]
                    text = sep.join([buffer[f[i] : l[i]] for i in o.tolist()])
                    meta = pack([np.diff(doc[o], prepend=0), tag[o], narrow(start[o]), narrow(count[o]), many[o].astype(np.uint8)])
                    rows.append((k, len(o), squeeze.compress(text), meta, 0))
            if rows:
                yield _batch(rows)
                rows = []
                buffer = found = key = piece = start = count = first = last = own = doc = tag = order = None
                tidy()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "n", "text", "meta", "sure"])


def _collapse(buffer, key, doc, first, last, plan: Plan):
    """Of super-k-mers with the same bytes in this batch: which to ship, and which shipped ones are known to repeat.

    Unordered: one is shipped for all, and all are settled.  Ordered: those of the smallest document are shipped, the others are settled.
    """
    joined = np.frombuffer(buffer, np.uint8)
    h = slices(prefix(TABLE[joined]), first, last) ^ mix((last - first).astype(U))
    order = np.lexsort((np.arange(len(h)), doc, h))
    hs = h[order]
    same = np.flatnonzero(hs[1:] == hs[:-1])
    if not len(same):
        return None, np.zeros(len(key), bool)
    ship, many = np.ones(len(key), bool), np.zeros(len(key), bool)
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(hs)), 0))]
    for at in (same + 1).tolist():
        i, r = int(order[at]), int(head[at])
        if buffer[first[i] : last[i]] != buffer[first[r] : last[r]]:
            continue  # two strings of one hash: both are shipped
        if not plan.ordered:
            ship[i] = False
            many[r] = True
        elif doc[i] > doc[r]:
            ship[i] = False
    return ship, many


def _spans(doc, tag, start, count) -> tuple[list, list, list]:
    """One row a document: its spans of windows, packed."""
    o = np.lexsort((start, tag, doc))
    doc, tag, start, count = doc[o], tag[o], start[o], count[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    at = np.flatnonzero(new).tolist() + [len(doc)]
    both = np.stack([start, count], 1).astype(np.uint32)
    return doc[at[:-1]].tolist(), tag[at[:-1]].tolist(), [both[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def packed_words(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts as they do (zeros follow the last)."""
    a = np.frombuffer(buffer + bytes(7), np.uint8)
    for kind, bits in ((np.uint16, 8), (np.uint32, 16), (np.uint64, 32)):
        step = bits // 8
        a = (a[:-step].astype(kind) << kind(bits)) | a[step:]
    return a


def _offsets(k: int) -> list[int]:
    """Where to read eight bytes each so that k bytes are covered."""
    return [0] if k <= 8 else [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]


def _word(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return words[at] >> U(64 - 8 * k) if k < 8 else words[at]


def suffix_array(words: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at some places, cut at k bytes, in the order of their bytes: (their numbers in that order, whether each differs from the one before).

    Sorted by eight bytes; those that are alike so far are sorted again by the number of their group and the next five bytes, and so on (fewer than 2**24 suffixes are alike).
    """
    key = _word(words, begin, k)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    tied = ~new
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied)
    place, group, off = begin[order[at]], np.cumsum(new[at]), 8
    while off < k and len(at):
        off = min(off, k - 5)
        key = (group.astype(U) << U(40)) | (words[place + off] >> U(24))
        o = np.argsort(key)
        order[at], place, key = order[at][o], place[o], key[o]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        group = np.cumsum(fresh)[tied]
        at, place, off = at[tied], place[tied], off + 5
    return order, new


class Level:
    """One level of the logarithmic family: strings, and the places of distinct k-byte suffixes in them in the order of their bytes."""

    def __init__(self, buffer: bytes, where: np.ndarray, k: int):
        self.buffer, self.where, self.k = buffer, where.astype(np.int64), k
        self.words = packed_words(buffer)

    def find(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For suffixes at some places of other strings: where each stands in the order here, and whether it is here."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.where), np.int64)
        for off in _offsets(self.k):
            key = _word(words, at + off, self.k)
            live = np.flatnonzero(lo < hi)
            ends = []
            for after in (False, True):  # the first that is not less, and the first that is greater, within what was alike so far
                a, z = lo[live], hi[live]
                while True:
                    open_ = np.flatnonzero(a < z)
                    if not len(open_):
                        break
                    mid = (a[open_] + z[open_]) // 2
                    v, q = _word(self.words, self.where[mid] + off, self.k), key[live[open_]]
                    up = (v <= q) if after else (v < q)
                    a[open_[up]] = mid[up] + 1
                    z[open_[~up]] = mid[~up]
                ends.append(a)
            lo[live], hi[live] = ends
        return lo, lo < hi

    def merged(self, other: "Level") -> "Level":
        """One level of both, whose suffixes are all different."""
        lo, _ = self.find(other.words, other.where)
        return Level(self.buffer + other.buffer, np.insert(self.where, lo, other.where + len(self.buffer)), self.k)


def settle(table: pa.Table, plan: Plan, levels: list[Level] = (), keep: bool = False):
    """A bucket's packed strings -> spans of windows that count, one row a document; with `keep`, also the bucket's level of the windows that are new."""
    import zstandard

    got = [[], [], [], []]
    undo = zstandard.ZstdDecompressor()
    doc, tag, start, count, many, texts = [], [], [], [], [], []
    for row_n, text, meta, sure in zip(*(table.column(c).to_pylist() for c in ("n", "text", "meta", "sure")), strict=True):
        parts = unpack(meta)
        d, t, s, c = (x.astype(np.int64) for x in parts[:4])
        d = np.cumsum(d)
        if sure:
            for to, x in zip(got, (d, t, s, c), strict=True):
                to.append(x)
            continue
        for to, x in zip((doc, tag, start, count, many), (d, t, s, c, parts[4]), strict=True):
            to.append(x)
        texts.append(undo.decompress(text))
    level = None
    if doc:
        sep = b"\n" if plan.words else b""
        buffer = sep.join(texts) + sep
        doc, tag, start, count, many = (np.concatenate(x) for x in (doc, tag, start, count, many))
        if plan.ordered:
            flag, level = ordered(buffer, doc, count, plan, levels, keep)
        else:
            flag = unordered(buffer, count, many.astype(bool), plan)
        w = np.flatnonzero(flag)
        if len(w):
            base = np.cumsum(count) - count
            sk = np.searchsorted(base, w, side="right") - 1
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1] + 1) | (sk[1:] != sk[:-1])
            at = np.flatnonzero(new)
            runs = np.diff(np.concatenate((at, [len(w)])))
            for to, x in zip(got, (doc[sk[at]], tag[sk[at]], start[sk[at]] + w[at] - base[sk[at]], runs), strict=True):
                to.append(x)
    if got[0]:
        d, t, s = _spans(*(np.concatenate(x) for x in got))
    else:
        d, t, s = [], [], []
    tidy()
    spans = pa.table({"doc_id": pa.array(d, pa.int64()), "tag": pa.array(t, pa.int64()), "spans": pa.array(s, pa.binary())})
    return (spans, level) if keep else spans


def _windows(buffer: bytes, count: np.ndarray, plan: Plan):
    """Hash, string, first and last byte of every window of words of a bucket; cut in chunks to bound memory."""
    k, n_strings = plan.k, len(count)
    length = count + k - 1  # units of each string
    total = np.concatenate(([0], np.cumsum(length)))
    joined = np.frombuffer(buffer, np.uint8)
    if plan.words:
        spaces = np.flatnonzero((joined == 10) | (joined == 32))  # each unit ends at one
        first = np.concatenate(([0], spaces + 1))
        last = spaces
    hashes, begin, end = [], [], []
    at = 0
    while at < n_strings:
        to = max(at + 1, int(np.searchsorted(total, total[at] + plan.chunk // (6 if plan.words else 1), side="right")) - 1)
        a, b = int(total[at]), int(total[to])
        if plan.words:
            x, y = int(first[a]), int(last[b - 1])
            values, _, _ = word_hashes(joined[x : y + 1])
        else:
            values = TABLE[joined[a:b]]
        g = grams(values, k)
        within = np.repeat(total[at:to] - a, count[at:to]) + _ramp(count[at:to])
        hashes.append(g[within])
        u = within + a
        begin.append((first[u] if plan.words else u).astype(np.int32))
        end.append((last[u + k - 1] if plan.words else u + k).astype(np.int32))
        at = to
    return np.concatenate(hashes), np.repeat(np.arange(n_strings, dtype=np.int32), count), np.concatenate(begin), np.concatenate(end)


def _ramp(count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _same(buffer: bytes, a0, a1, b0, b1, sk) -> np.ndarray:
    """Whether the windows [a0, a1) and [b0, b1) hold the same bytes, run by run of windows shifted alike."""
    ok = np.ones(len(a0), bool)
    if not len(a0):
        return ok
    new = np.ones(len(a0), bool)
    new[1:] = (sk[1:] != sk[:-1]) | ((a0 - b0)[1:] != (a0 - b0)[:-1]) | (a0[1:] > a1[:-1]) | (a0[1:] < a0[:-1])
    at = np.flatnonzero(new)
    stop = np.concatenate((at[1:], [len(a0)]))
    for i, j, x0, x1, y0, y1 in zip(at.tolist(), stop.tolist(), a0[at].tolist(), a1[stop - 1].tolist(), b0[at].tolist(), b1[stop - 1].tolist(), strict=True):
        if buffer[x0:x1] != buffer[y0:y1]:  # some pair of one hash differs: look at each
            for q in range(i, j):
                ok[q] = buffer[a0[q] : a1[q]] == buffer[b0[q] : b1[q]]
    return ok


def unordered(buffer: bytes, count, many, plan: Plan) -> np.ndarray:
    """Whether each window starts anywhere else too: sorted by hash, equal neighbours are counted."""
    h, own, begin, end = _windows(buffer, count, plan)
    order = np.argsort(h)
    hs = h[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    alone = size[group] == 1
    head = np.flatnonzero(new)[group]
    rep = np.empty(len(h), np.int64)
    rep[order] = order[head]
    multi = np.zeros(len(h), bool)
    multi[order] = ~alone
    mem = np.flatnonzero(multi & (rep != np.arange(len(h))))
    ok = _same(buffer, begin[mem], end[mem], begin[rep[mem]], end[rep[mem]], own[mem])
    hit = many[own].copy()
    hit[mem[ok]] = True
    hit[rep[mem[ok]]] = True
    if not ok.all():  # strings of one hash that differ: count such groups by their bytes
        bad = np.unique(rep[mem[~ok]])
        for r in bad.tolist():
            seen: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(rep == r).tolist():
                seen.setdefault(buffer[begin[i] : end[i]], []).append(i)
            for them in seen.values():
                hit[them] = len(them) > 1 or many[own[them[0]]]
    return hit


def ordered(buffer: bytes, doc, count, plan: Plan, levels: list[Level] = (), keep: bool = False) -> tuple[np.ndarray, Level | None]:
    """Whether each window of bytes starts in a document with a smaller doc_id too, and the level of those that are new.

    Strings that are equal are judged once, by the one of the smallest document.  The batch's suffix array puts equal windows side by side; what is left is scanned against the levels, all
    of smaller documents.
    """
    length = count + plan.k - 1
    end = np.cumsum(length)
    first, last, seen = (end - length).tolist(), end.tolist(), {}
    rep = np.empty(len(count), np.int64)
    for i in np.argsort(doc, kind="stable").tolist():
        rep[i] = seen.setdefault(buffer[first[i] : last[i]], i)
    once = np.flatnonzero(rep == np.arange(len(rep)))
    own = count[once]
    buffer, n = b"".join([buffer[first[i] : last[i]] for i in once.tolist()]), int(own.sum())
    del seen
    words = packed_words(buffer)
    begin = (np.arange(n) + np.repeat(np.arange(len(own)) * (plan.k - 1), own)).astype(np.int32)  # each string has k - 1 bytes more than windows
    place = np.unique(doc[once], return_inverse=True)[1].astype(np.int32)  # documents by number, in order
    order, new = suffix_array(words, begin, plan.k)
    d = np.repeat(place, own)[order]
    head = np.flatnonzero(new)
    least = np.minimum.reduceat(d, head) if n else d
    group = np.cumsum(new, dtype=np.int32) - 1
    late = d > least[group]
    fresh = np.ones(len(head), bool)
    for level in levels:
        _, here = level.find(words, begin[order[head]].astype(np.int64))
        fresh &= ~here
    if levels:
        late |= ~fresh[group]
    hit = np.zeros(n, bool)
    hit[order] = late
    # Back to all strings: copies in later documents count whole, copies in the same one as their like.
    alone = np.zeros(len(rep), bool)
    alone[once] = True
    flag = np.ones(int(count.sum()), bool)
    flag[np.repeat(alone, count)] = hit
    mine = np.zeros(len(rep), np.int64)
    mine[once] = np.cumsum(own) - own
    at = np.cumsum(count) - count
    for i in np.flatnonzero(~alone & (doc == doc[rep])).tolist():
        flag[at[i] : at[i] + count[i]] = hit[mine[rep[i]] : mine[rep[i]] + count[i]]
    return flag, Level(buffer, begin[order[head[fresh]]], plan.k) if keep else None


def hot_grams(docs: DataFrame, plan: Plan, sample: int = 2000, share: float = 0.02) -> np.ndarray:
    """Grams in over `share` of a sample of about `sample` documents (by hash of the row).  They only change where windows meet,
    never what is found.  At most 1/share grams per gram of a mean document: bounded, and small next to a task's memory."""
    total = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1))))

    def count(batches):
        out = []
        for b in batches:
            for t in b.column(2).to_pylist():
                v, _, _ = units(np.frombuffer(normal(t, plan.words)[:CHUNK], np.uint8), plan.words)
                out.append(np.unique(grams(v, plan.m) >> U(1)))
        g, n = np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, U), np.zeros(0, np.int64))
        more = n > min(2, len(out) // 50)  # too rare here to be hot
        yield pa.RecordBatch.from_arrays([pa.array(g[more].astype(np.int64)), pa.array(n[more].astype(np.int64))], names=["g", "n"])

    seen = min(total, sample)
    rows = some.repartition(4).mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") > max(8, share * seen)).select("g").toPandas()
    return np.sort(rows["g"].to_numpy(np.int64).astype(U))


def planned(docs: DataFrame, k: int, m: int, words: bool, ordered_: bool, bucket_bytes: float = 10e6) -> Plan:
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    plan = Plan(k, m, words, partitions_for(docs.sparkSession, volume * 3.3, bucket_bytes), ordered_)
    plan.hot = hot_grams(docs, plan)
    return plan


def dealt(docs: DataFrame, plan: Plan) -> DataFrame:
    """docs' super-k-mers, packed by bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    return docs.select("doc_id", "tag", "text").mapInArrow(lambda it: deal(it, shared.value), BUCKET_SCHEMA).repartition(plan.buckets, "bucket")


def repeated_windows(docs: DataFrame, k: int, m: int, words: bool, ordered_: bool, bucket_bytes: float = 10e6) -> DataFrame:
    """docs(doc_id bigint, tag bigint, text binary) -> one or more rows a document with spans of windows that repeat:
    pairs of uint32 (first window, windows).  Documents without any have no row."""
    plan = planned(docs, k, m, words, ordered_, bucket_bytes)
    light = Plan(k, m, words, plan.buckets, ordered_)
    return dealt(docs, plan).groupBy("bucket").applyInArrow(lambda t: settle(t, light), SPAN_SCHEMA)


def covered(spans: list[bytes], n: int, k: int) -> np.ndarray:
    """Which of n units some window covers."""
    step = np.zeros(n + 1, np.int64)
    for blob in spans or []:
        s = np.frombuffer(blob, np.uint32).reshape(-1, 2).astype(np.int64)
        np.add.at(step, s[:, 0], 1)
        np.add.at(step, np.minimum(s[:, 0] + s[:, 1] + k - 1, n), -1)
    return np.cumsum(step)[:n] > 0


