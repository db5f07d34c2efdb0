"""Names that were probably misheard: rare words of a session, clustered by edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_tokens, near, stem
from ..sources.sessions import spread, written

FLOOR = 2.0
#: Words shorter than this may differ in one edit, others in two (functions.text.tolerance).
SHORT = 6
#: So many links of clusters are joined in one task.
FEW = 20_000


def lexicon(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, zipf (log10 of occurrences per thousand million) from a corpus.  The counts are written once, so that the corpus is read once however often the lexicon is used."""
    words = spread(texts.select(text)).select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = written(words, "lexicon")
    total = words.agg(F.sum("n").alias("total"))
    return words.join(F.broadcast(total)).select("word", F.log10(F.col("n") / F.col("total") * 1e9).alias("zipf"))


def surface_tokens(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Session, ord, turn id, place, token and stem of every name-like token."""
    x = turns.select(key, "ord", "id", F.posexplode(name_tokens("text")).alias("pos", "token"))
    return x.withColumn("stem", stem("token"))


def rare_tokens(tokens: DataFrame, words: DataFrame, floor: float = FLOOR, least: int = 3) -> DataFrame:
    """tokens whose stem is long enough, a word, under the floor, and no plural of a word over it.

    The words over the floor are few (10 ** (9 - floor) at most, by what zipf means), so tokens are sifted by them where they are; the long tail of the lexicon is not joined here, nor are frequent stems shuffled.
    """
    common = words.filter(F.col("zipf") >= floor)
    if floor <= 0:  # unknown words, of zipf 0, are not under such a floor
        tokens = tokens.join(words.select(F.col("word").alias("_w")), F.col("stem") == F.col("_w"), "left_semi")
    some = tokens.filter((F.length("stem") >= least) & F.col("stem").rlike("^[a-z]+$"))
    single = F.expr("CASE WHEN endswith(stem, 's') THEN substring(stem, 1, length(stem) - 1) END")
    some = some.join(common.select(F.col("word").alias("_w")), F.col("stem") == F.col("_w"), "left_anti").withColumn("_single", single)
    return some.join(common.select(F.col("word").alias("_w")), F.col("_single") == F.col("_w"), "left_anti").drop("_single")


def with_zipf(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows(stem, ...) with the frequency of their stem; an unknown word has zipf 0."""
    known = words.select(F.col("word").alias("_w"), F.col("zipf").alias("_z"))
    return rows.join(known, F.col("stem") == F.col("_w"), "left").withColumn("zipf", F.coalesce("_z", F.lit(0.0))).drop("_w", "_z")


def forms(rare: DataFrame, key: str = "session_id") -> DataFrame:
    """Spellings of each stem with their occurrences and turns (repeats kept, in order)."""
    turn_ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "id"))), lambda x: x["id"])
    return rare.groupBy(key, "stem", "token").agg(F.count("*").alias("occurrences"), turn_ids.alias("turn_ids"))


#: How a word of a tolerance k is found: segment i (of k + 1, from 0) of a word that is d letters shorter, moved by `shift`.  A segment can be found whole only where the edits before it, and those after it, move it: it starts
#: between p - i and p + i and between p + d - (k - i) and p + d + (k - i).
PROBES = [(k, d, i, shift) for k in (1, 2) for d in range(k + 1) for i in range(k + 1) for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1)]


def _segments(stems: DataFrame, key: str, word: str, ways: list[tuple[int, int, int, int]]) -> DataFrame:
    """key, word, and (n, i, s): the number, length and text of segments.  A word of n letters is cut as evenly as can be, longer segments last."""
    rows = stems.select(F.col(key).alias("_k"), F.col("stem").alias(word), F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip("kdim", way, strict=True)]) for way in ways])).alias("_w"))
    rows = rows.select("_k", word, F.col("_w.k").alias("_t"), F.col("_w.i").alias("_i"), F.col("_w.m").alias("_m"), (F.length(word) - F.col("_w.d")).alias("_n"))
    rows = rows.filter((F.col("_n") >= 1) & ((F.col("_n") < SHORT) == (F.col("_t") == 1)))
    at, size = "1 + _i * (_n div (_t + 1)) + greatest(0, _i - _t - 1 + _n % (_t + 1)) + _m", "_n div (_t + 1) + if(_i >= _t + 1 - _n % (_t + 1), 1, 0)"
    rows = rows.select("_k", word, "_n", "_i", F.expr(at).cast("int").alias("_at"), F.expr(size).cast("int").alias("_size"))
    return rows.filter(f"_at >= 1 and _at + _size - 1 <= length({word})").select("_k", word, "_n", "_i", F.expr(f"substring({word}, _at, _size)").alias("_s"))


def near_pairs(stems: DataFrame, key: str = "session_id") -> DataFrame:
    """Pairs of a session's (distinct) stems within the tolerance k of the shorter one, which is cut into k + 1 segments: k edits leave one of them whole.  Stems meet under the segments that they have in common, two
    or three a word in the index and up to sixteen in search of them, so no session's stems are all compared; distances are computed for what has met only."""
    index = _segments(stems, key, "_a", [(k, 0, i, 0) for k in (1, 2) for i in range(k + 1)])
    probe = _segments(stems, key, "_b", PROBES)
    met = probe.join(index, ["_k", "_n", "_i", "_s"]).filter("_n < length(_b) or _a < _b")  # words of one length find each other: once is enough
    pairs = met.select(F.col("_k").alias(key), F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    return pairs.filter(near("a", "b"))


def _joined(links: DataFrame, key: str) -> DataFrame:
    """key, a, end: the points of FEW links at most, joined in one task; each gets the least point of its component."""
    kind = links.schema[key].dataType.simpleString()

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[tuple, tuple] = {}

        def find(x: tuple) -> tuple:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for pdf in frames:
            for k, a, b in zip(pdf[key], pdf["a"], pdf["b"], strict=True):
                x, y = sorted((find((k, a)), find((k, b))))
                up[y] = x
        yield pd.DataFrame([(k, a, find((k, a))[1]) for k, a in list(up)], columns=[key, "a", "end"])

    return links.coalesce(1).mapInPandas(join, f"{key} {kind}, a string, end string")


def clusters(stems: DataFrame, pairs: DataFrame, key: str = "session_id") -> DataFrame:
    """G1: session, stem, root (the least stem of its single-link cluster) of every stem."""
    return stems.select(key, "stem").join(linked(pairs, key), [key, "stem"], "left").withColumn("root", F.coalesce("root", "stem"))


def linked(pairs: DataFrame, key: str = "session_id") -> DataFrame:
    """session, stem, root of the stems that have a neighbour.

    While there are over FEW links, a round points every stem to the neighbour (or itself) that comes first in a random order, then to where that one points, and contracts the links to what they point to; loops and
    repeats go, so links shrink by a factor a round whatever the shape of a cluster.  What is left is joined in one task.  The least stem of what ends in one point is the root.
    """
    at = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("s"))
    edges, ends = written(pairs.select(key, "a", "b"), "links"), None

    def moved(step: DataFrame) -> DataFrame:
        if ends is None:
            return step
        then = step.select(F.col(key).alias("_k"), F.col("a").alias("_e"), F.col("end").alias("_z"))
        return ends.join(then, (F.col(key) == F.col("_k")) & (F.col("end") == F.col("_e")), "left").select(key, "a", F.coalesce("_z", "end").alias("end"))

    while edges.count() > FEW:
        both = edges.unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(key, "a").agg(F.min(at("b")).alias("m"))
        first = written(first.select(key, "a", F.least("m", at("a"))["s"].alias("to")), "first")
        step = written(first.join(first.select(key, F.col("a").alias("to"), F.col("to").alias("end")), [key, "to"]).select(key, "a", "end"), "steps")
        ends = written(moved(step), "ends")
        x, y = step.select(key, "a", F.col("end").alias("x")), step.select(key, F.col("a").alias("b"), F.col("end").alias("y"))
        edges = written(edges.join(x, [key, "a"]).join(y, [key, "b"]).filter("x <> y").select(key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if ends is None:
        return _joined(edges, key).select(key, F.col("a").alias("stem"), F.col("end").alias("root"))
    ends = moved(_joined(edges, key))
    roots = ends.groupBy(key, "end").agg(F.min("a").alias("root"))
    return ends.join(roots, [key, "end"]).select(key, F.col("a").alias("stem"), "root")


def grounds(stems, zipf):
    """why a candidate is one."""
    return F.when(stems > 1, F.format_string("spelled %d ways", stems)).when(zipf == 0, "in no lexicon").otherwise("rare in general")


def candidates(turns: DataFrame, words: DataFrame, floor: float = FLOOR, key: str = "session_id") -> DataFrame:
    """Name candidates of each session, the most contradictory first: id, forms, occurrences, distinct stems, grounds."""
    f = written(with_zipf(forms(rare_tokens(surface_tokens(turns, key), words, floor), key), words), "forms")
    rooted = f.join(linked(near_pairs(f.select(key, "stem").distinct(), key), key), [key, "stem"], "left").withColumn("root", F.coalesce("root", "stem"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("neg"), F.col("token").alias("text"), "turn_ids", "zipf")))
    g = rooted.groupBy(key, "root").agg(best.alias("f"), F.sum("occurrences").alias("occurrences"), F.count_distinct("stem").alias("stems"), F.count_distinct(F.lower("token")).alias("spellings"))
    w = Window.partitionBy(key).orderBy(F.desc("stems"), F.desc("occurrences"), "root")
    out = g.withColumn("grounds", grounds(F.col("stems"), F.get("f", F.lit(0))["zipf"])).withColumn("candidate_id", F.format_string("n%04d", F.row_number().over(w) - 1))
    shown = F.transform("f", lambda x: F.struct(x["text"].alias("text"), (-x["neg"]).alias("occurrences"), x["turn_ids"].alias("turn_ids")))
    return out.select(key, "candidate_id", "root", shown.alias("forms"), "occurrences", "stems", "spellings", "grounds")
