"""Conversation structure repair by a dynamic programme over a trie of signatures.

A row is one sign: its role's initial and whether it must go, may stay or lost its end.  A conversation's signs in order are its signature.  Distinct signatures, sorted, are a prefix trie read from left to
right: a task keeps the layers of the programme for the signature before, drops those below the prefix that the next one shares with it and computes the rest, so every shared prefix is computed once in a task; at a
signature's end the answer is read off.  A layer has four states (nothing yet, after a system row, after a user's, after an assistant's) with the least cost, the place of its edits among the
layer's in ASCII order, and the edits since the layer above, so memory grows with the longest signature and not with its square.

Rows are shuffled by conversation twice, without their texts to find the signatures and with them to carry out the edits; both times sorted rows are streamed, so a conversation of any length needs no more
memory than its signature (a byte a row) and its edits, which are results.  One conversation's rows pass through one task, since their order, edits and digest are those of a sequence.

Defined results: a null conv_id is a conversation of its own; a null turn sorts first and counts for no gap; a null role or text is one space, as are nulls in the text that is hashed for damage; rows of
one turn are in the order of their role and then of their text's SHA-256; repeated rows are duplicates; a role whose initial is none of s, u and a can only be changed or deleted; a conversation
whose rows are all gone has zeros, no edits and the digest of the empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, documents, lean, partitions_for, stored

BLANKS = " \t\n\x0b\x0c\r"
#: Signs of rows that may stay by role (s, u, a, other), whole and without an end; and of one that must go.
WHOLE, CUT, GO = "suax", "SUAX", "-"
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: The state after a user's or assistant's row is put in, by rewriting or inserting.
PUT = (2, 2, 3, 2)
#: Inserts that end a conversation in each state.
TAIL = ("", "II", "I", "")
CONVERSATION = "conv_id bigint, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, signature string"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage by the checksum of `conv_id:turn`; a dropped row stays with `gone`, so that no conversation is lost."""
    space = F.lit(" ")
    at = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    x = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        F.pmod(F.crc32(at.cast("binary")), F.lit(20)).alias("k"),
    )
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    x = x.withColumn("role", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role"))).withColumn("text", text)
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.withColumn("_copy", F.explode(copies)).select("conv_id", "turn", "role", "text", (F.col("k") == 0).alias("gone"))


def _signed(rows: DataFrame, parts: int) -> DataFrame:
    """conv_id, turn, code of every row, conversations together and in order; code: 4 * fault (none, blank, duplicate, truncated) + role (s, u, a, other), -1 where it is gone."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    x = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "gone", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("who"),
    ).repartition(parts, "conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "gone").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    x = x.withColumn("again", again).sortWithinPartitions("conv_id", "turn", "role", "digest", "again")
    return x.select("conv_id", "turn", F.when(F.col("gone"), -1).otherwise(4 * fault + F.col("who")).cast("int").alias("code"))


class _Conversation:
    """What is known of a conversation after its rows so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.signs, self.faults, self.illegal = conv_id, [], np.zeros(4, np.int64), 0
        self.least = self.most = self.last = None
        self.turns, self.role = 0, None

    def add(self, codes: np.ndarray, turns: np.ndarray, known: np.ndarray) -> None:
        there = codes >= 0
        codes, turns = codes[there], turns[there & known]
        if not len(codes):
            return
        fault, who = codes // 4, codes % 4
        self.faults += np.bincount(fault, minlength=4)
        self.signs.append(SIGNS[codes].tobytes())
        before = who[:-1] if self.role is None else np.concatenate(([self.role], who[:-1]))
        self.illegal += int((~LEGAL_PAIR[before, who[-len(before) :]]).sum()) if len(before) else 0
        self.role = int(who[-1])
        if len(turns):  # sorted
            self.turns += int((turns[1:] != turns[:-1]).sum()) + int(self.last is None or int(turns[0]) != self.last)
            self.least = int(turns[0]) if self.least is None else self.least
            self.most = self.last = int(turns[-1])

    def row(self) -> tuple:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        return (self.conv_id, int(self.faults.sum()), gaps, *map(int, self.faults[1:]), self.illegal, b"".join(self.signs).decode())


SIGNS = np.frombuffer((WHOLE + GO * 8 + CUT).encode(), np.uint8)
LEGAL_PAIR = np.array([[(x, y) in LEGAL for y in range(4)] for x in range(4)])


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def conversations_of(signed: DataFrame) -> DataFrame:
    """A row a conversation: its counts and its signature."""

    def run(batches):
        now = None
        for b in batches:
            ids, named = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            turns, known = b.column(1).fill_null(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            codes = b.column(2).to_numpy()
            start = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (named[1:] != named[:-1])))) if len(ids) else []
            done = []
            for a, z in zip(start, [*start[1:], len(ids)], strict=True):
                one = int(ids[a]) if named[a] else None
                if now is None or now.conv_id != one:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(one)
                now.add(codes[a:z], turns[a:z], known[a:z])
            yield _columns(done, CONVERSATION)
        if now is not None:
            yield _columns([now.row()], CONVERSATION)

    return signed.mapInArrow(run, CONVERSATION)


# ------------------------------------------------------------------------------------------ the programme on the trie

# A layer: for each state None or (cost, place, state above, edits since); of equal costs the least place wins.
ROOT = ((0, 0, 0, ""), None, None, None)


def step(layer: tuple, sign: str) -> tuple:
    """The layer below: a row is deleted, kept or rewritten, with an insert before it where that is of use (two or more, or one before a deletion, never are)."""
    best: list[tuple | None] = [None] * 4

    def offer(to: int, cost: int, place: int, above: int, edits: str) -> None:
        if best[to] is None or (cost, place, edits) < (best[to][0], best[to][1], best[to][3]):
            best[to] = (cost, place, above, edits)

    role, extra = sign.lower(), int(sign in CUT)
    for s, x in enumerate(layer):
        if x is None:
            continue
        cost, place = x[0], x[1]
        offer(s, cost + 3, place, s, "D")
        if sign == GO:
            continue
        for at, c, before in ((s, cost + extra, ""), (PUT[s], cost + extra + 2, "I")):
            if (role, at) in KEEP:
                offer(KEEP[role, at], c, place, s, before + "K")
            offer(PUT[at], c + 2, place, s, before + "R")
    order = sorted((x[1], x[3], s) for s, x in enumerate(best) if x is not None)
    for i, (_, edits, s) in enumerate(order):
        best[s] = (best[s][0], i, best[s][2], edits)
    return tuple(best)


def answer(layers: list[tuple]) -> tuple[int, str]:
    """Cost and edits of the signature that led to the last layer."""
    cost, _, s = min((x[0] + 2 * len(TAIL[s]), x[1], s) for s, x in enumerate(layers[-1]) if x is not None)
    pieces = [TAIL[s]]
    for layer in reversed(layers[1:]):
        pieces.append(layer[s][3])
        s = layer[s][2]
    return cost, "".join(reversed(pieces))


def shared(a: str, b: str) -> int:
    """The length of the prefix that two signatures have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = (np.frombuffer(t[:n].encode(), np.uint8) for t in (a, b))
    return int((x != y).argmax())


def walk(signatures):
    """Sorted signatures -> (signature, cost, edits), layers of shared prefixes computed once."""
    layers, before = [ROOT], ""
    for sig in signatures:
        del layers[shared(before, sig) + 1 :]
        for sign in sig[len(layers) - 1 :]:
            layers.append(step(layers[-1], sign))
        before = sig
        yield sig, *answer(layers)


def audits(signatures: DataFrame, parts: int) -> DataFrame:
    """signatures(key, signature, _n) -> key, cost, audit, _n."""
    schema = "key string, _n bigint, cost bigint, audit string"

    def run(batches):
        kept = []  # keys and numbers of the signatures that the walk has been given and not answered yet

        def given():
            for b in batches:
                for key, sig, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    kept.append((key, n))
                    yield sig

        rows = []
        for _, cost, audit in walk(given()):
            rows.append((*kept.pop(), cost, audit))
            if len(rows) == 1000:
                yield _columns(rows, schema)
                rows = []
        yield _columns(rows, schema)

    return signatures.select("key", "signature", "_n").repartitionByRange(parts, "signature").sortWithinPartitions("signature").mapInArrow(run, schema)


def solved(rows: DataFrame) -> DataFrame:
    """Every conversation of rows(conv_id, turn, role, text, gone): conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(conversations_of(_signed(rows, parts)).withColumn("key", F.sha2("signature", 256)), "conversations")
    some = found.groupBy("key").agg(F.first("signature").alias("signature"), F.count("*").alias("_n"))
    told = stored(audits(some, parts), "audits")
    return attach(found.drop("signature"), told, "key", "_n", found.count()).drop("key", "_n")


def _edited(batches):
    """Sorted rows, a conversation's audit before its rows -> its audit row's columns as a tuple, then (role, text, edit) of each edit but deletions, in order."""
    head, audit, at, state = None, "", 0, 0

    def inserts(stop: int):
        nonlocal at, state
        while at < stop and audit[at] == "I":
            state, role = PUT[state], ("user", "assistant")[state == 2]
            at += 1
            yield role, "", "I"

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for conv_id, first, role, text, edits in zip(*cols, strict=True):
            if first:
                yield from inserts(len(audit))
                head, audit, at, state = conv_id, edits or "", 0, 0
                yield (head,)
                continue
            yield from inserts(len(audit))
            edit = audit[at]
            at += 1
            if edit == "R":
                role, state = ("user", "assistant")[state == 2], PUT[state]
            elif edit == "K":
                state = KEEP[role[:1], state]
            if edit != "D":
                yield role, text, edit
    yield from inserts(len(audit))


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Conversations together, each one's audit first and its rows in order after it."""
    spark = rows.sparkSession
    none = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(True).alias("first"), F.lit(None).cast("bigint").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    body = rows.filter(~F.col("gone")).select("conv_id", F.lit(False).alias("first"), "turn", "role", "text", none.alias("audit"))
    both = heads.unionByName(body).withColumn("digest", F.sha2("text", 256)).repartition(partitions_for(spark, 1, 1), "conv_id")
    return both.sortWithinPartitions("conv_id", F.desc("first"), "turn", "role", "digest").select("conv_id", "first", "role", "text", "audit")


def repaired(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text, edit (K kept, R role changed, I inserted)."""
    lean(rows.sparkSession)
    found = solved(rows) if found is None else found
    schema = "conv_id bigint, position bigint, role string, text string, edit string"

    def run(batches):
        out, size, conv, n = [], 0, None, 0
        for x in _edited(batches):
            if len(x) == 1:
                conv, n = x[0], 0
                continue
            out.append((conv, n, *x))
            n += 1
            size += len(x[1])
            if len(out) == 4096 or size > 1 << 22:
                yield _columns(out, schema)
                out, size = [], 0
        yield _columns(out, schema)

    return _in_order(rows, found).mapInArrow(run, schema)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of `role:text` of the repaired rows, joined by newlines."""
    schema = "_conv bigint, repaired_sha256 string"

    def run(batches):
        out, conv, sha, n = [], None, None, 0
        for x in _edited(batches):
            if len(x) == 1:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha, n = x[0], hashlib.sha256(), 0
                if len(out) >= 4096:
                    yield _columns(out, schema)
                    out = []
                continue
            sha.update(f"{chr(10) if n else ''}{x[0]}:{x[1]}".encode())
            n += 1
        if sha is not None:
            out.append((conv, sha.hexdigest()))
        yield _columns(out, schema)

    return _in_order(rows, found).mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """Every conversation of rows(conv_id, turn, role, text, gone) with its faults, the cost and edits of its repair and the digest of what it gives."""
    lean(rows.sparkSession)
    found = stored(solved(rows), "solved")
    out = found.join(digests(rows, found), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damaged(documents(spark, sf_dir, "conversations")))


SQL = r"""
WITH RECURSIVE bits(n, k, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)) AS b FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS k FROM raw, crc),
ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
dam AS (SELECT cid, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS twice FROM hit WHERE k > 0) h JOIN ids ON h.conv_id IS NOT DISTINCT FROM ids.conv_id),
num AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM dam),
fau AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS who,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '' ELSE 'truncated' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS pair FROM num),
cnt AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM fau GROUP BY cid),
put(s, to_) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
keep(who, s, to_) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
moves(who, s, to_, cost, e) AS (SELECT who, s, to_, 0, 'K' FROM keep UNION ALL SELECT k.who, p.s, k.to_, 2, 'IK' FROM put p JOIN keep k ON p.to_ = k.s
  UNION ALL SELECT w, s, to_, 2, 'R' FROM put, (VALUES ('s'), ('u'), ('a'), ('x')) v(w) UNION ALL SELECT w, p.s, q.to_, 4, 'IR' FROM put p JOIN put q ON p.to_ = q.s, (VALUES ('s'), ('u'), ('a'), ('x')) v(w)),
opts AS (SELECT cid, i, s, to_, cost + (fault = 'truncated')::INT AS cost, e FROM fau JOIN moves USING (who) WHERE fault NOT IN ('blank', 'duplicate') UNION ALL SELECT cid, i, s, s, 3, 'D' FROM fau, put),
dp(cid, i, s, v) AS (SELECT cid, 0::BIGINT, 0, '00000000' FROM cnt
  UNION ALL SELECT d.cid, d.i + 1, o.to_, min(lpad((left(v, 8)::INT + o.cost)::VARCHAR, 8, '0') || substr(v, 9) || o.e) FROM dp d JOIN opts o ON o.cid = d.cid AND o.i = d.i + 1 AND o.s = d.s GROUP BY d.cid, d.i + 1, o.to_),
done AS (SELECT cid, min(lpad((left(v, 8)::INT + 2 * len(tail))::VARCHAR, 8, '0') || substr(v, 9) || tail) AS v FROM dp JOIN cnt USING (cid) JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) t(s, tail) USING (s) WHERE i = n GROUP BY cid),
edits AS (SELECT cid, p, substr(v, 8 + p, 1) AS e FROM (SELECT cid, v, unnest(range(1, len(v) - 7)) AS p FROM done)),
placed AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY cid ORDER BY p)),
met AS (SELECT p.cid, p.p, p.e, p.o, f.role, f.text, max((e = 'K' AND f.who = 's')::INT) OVER (PARTITION BY p.cid) AS sys FROM placed p LEFT JOIN fau f ON f.cid = p.cid AND f.i = p.i),
whole AS (SELECT cid, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM met WHERE e <> 'D' GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(left(v, 8)::BIGINT, 0) AS cost, coalesce(substr(v, 9), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN cnt USING (cid) LEFT JOIN done USING (cid) LEFT JOIN whole USING (cid)
"""
