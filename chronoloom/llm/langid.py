"""Language identification in two steps: first the family, then its closely related languages one against one, with linear support vector machines.

Features are counts of hashed 2-, 3- and 4-byte grams of the whole text (ASCII lower-cased), as shares of their number.  One machine for each family against the
others picks the family; within a family one machine for each pair of its languages votes.  All are trained together by averaged stochastic
subgradients of the hinge loss, in one task, on documents chosen by hash among those that are not held out: at most `most` of all, and of each language FEW (or all it
has), so that rare languages are learned too; these are `most` together at most, the first of every language before the second of any.

Defined results: a null text, or one without a letter, is `und` with score 0; so is everything where nothing could be learned; a null lang is never learned
from; a null doc_id is not held out; repeated rows get equal results; an empty table gives an empty result; other columns are not read.
"""

import pickle

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TABLE, documents, groups_of, lean, lower_ascii, mix, powers, prefix, smallest_hashes, stored, tidy

DIM = 1 << 13
SIZES = (2, 3, 4)
#: Documents learned from, at most, whatever their language, and bytes of each sampled text (all are scored whole); longer texts are sampled, by their beginning, only where a language has fewer
#: than FEW others.
SAMPLE = 4000
LONGEST = 40_000
#: Values of lang (a row each) that may be broadcast; more are shuffled.
MANY = 100_000
FEW = 50
# Families of languages by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "semitic": "ar he mt",
    "turkic": "az kk ky tr uz",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def features(texts: list[bytes]) -> np.ndarray:
    """Shares of hashed grams, a row for each text."""
    out = np.zeros((len(texts), DIM), np.float32)
    joined = lower_ascii(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    p, end = prefix(TABLE[joined]), 0
    inverse = powers(len(p))[1]
    for i, t in enumerate(texts):
        a, end = end, end + len(t) + 1
        for n in SIZES:
            if len(t) >= n:
                m = len(t) - n + 1
                g = mix((p[a + n : a + n + m] - p[a : a + m]) * inverse[a : a + m])
                out[i] += np.bincount((g & np.uint64(DIM - 1)).astype(np.int64), minlength=DIM)
    total = out.sum(1, keepdims=True)
    return out / np.maximum(total, 1)


def fit(x: np.ndarray, langs: list[str], epochs: int = 40, penalty: float = 1e-4) -> dict:
    """Weights of family-against-rest and language-against-language machines, one column each."""
    names = sorted(set(langs))
    families = sorted({FAMILY.get(c, c) for c in names})
    own = np.array([families.index(FAMILY.get(c, c)) for c in langs])
    lang = np.array([names.index(c) for c in langs])
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if FAMILY.get(names[a], names[a]) == FAMILY.get(names[b], names[b])]
    y = np.zeros((len(langs), len(families) + len(pairs)), np.float32)  # 0: not a case of this machine
    for f in range(len(families)):
        y[:, f] = np.where(own == f, 1, -1)
    for j, (a, b) in enumerate(pairs):
        y[:, len(families) + j] = (lang == a).astype(np.float32) - (lang == b)
    scale = 1 / np.sqrt(x.mean(0) + 1e-6)
    x *= scale  # in place: there may be a hundred megabytes of it
    norm = np.float32(np.sqrt(np.einsum("ij,ij->i", x, x).mean()) + 1e-9)
    x /= norm
    z = x
    w, bias = np.zeros((DIM, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    mean_w, mean_b, steps = np.zeros_like(w), np.zeros_like(bias), 0
    rng = np.random.default_rng(11)
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(langs))
        for a in range(0, len(order), 64):
            b = order[a : a + 64]
            t += 1
            rate = 2.0 / (1 + t * 0.01)
            miss = y[b] * ((y[b] * (z[b] @ w + bias)) < 1)
            w *= 1 - rate * penalty
            w += (rate / len(b)) * (z[b].T @ miss)
            bias += (0.1 * rate / len(b)) * miss.sum(0)
            if epoch >= epochs // 2:
                mean_w += w
                mean_b += bias
                steps += 1
    w, bias = mean_w / max(steps, 1), mean_b / max(steps, 1)
    return {"names": names, "families": families, "pairs": pairs, "w": (w * scale[:, None] / norm).astype(np.float32), "b": bias}


def decide(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    m = x @ model["w"] + model["b"]
    families, names, pairs = model["families"], model["names"], model["pairs"]
    p = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
    nf = len(families)
    best = m[:, :nf].argmax(1)
    sure = p[np.arange(len(x)), best] / np.maximum(p[:, :nf].sum(1), 1e-9)
    if nf == 1:
        sure = np.ones(len(x))
    votes, margin = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for j, (a, b) in enumerate(pairs):
        q = p[:, nf + j]
        votes[:, a] += q > 0.5
        votes[:, b] += q <= 0.5
        margin[:, a] += q
        margin[:, b] += 1 - q
    of = np.array([families.index(FAMILY.get(c, c)) for c in names])
    inside = of[None, :] == best[:, None]
    rank = np.where(inside, votes + margin / (len(names) + 1), -1)
    lang = rank.argmax(1)
    others = np.maximum(inside.sum(1) - 1, 1)
    share = np.where(inside.sum(1) == 1, 1.0, margin[np.arange(len(x)), lang] / others)
    return [names[i] for i in lang], np.clip(sure * share, 0, 1)


def rare(known: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """text, lang of the documents with each language's FEW smallest hashes that are not in first (the smallest hashes of all); longer texts come last, and cut."""
    h = F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(1 << 40))
    last = first.agg(F.max(h)).first()[0]
    long = F.octet_length("text") > LONGEST
    counts = stored(known.groupBy("lang").agg(F.count_if(~long).alias("short"), F.count_if(long).alias("long")), "languages")
    rows = known.select(h.alias("h"), F.substring(F.col("text").cast("binary"), 1, LONGEST).alias("text"), F.col("lang"), long.alias("is_long"))
    counts = counts.withColumnRenamed("lang", "_lang")
    rows = rows.join(F.broadcast(counts) if counts.count() <= MANY else counts, F.col("lang") == F.col("_lang"))
    # A threshold leaves a few hundred rows of each language, so that no task sorts a language whole.
    below = lambda n: F.col("h") < F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(4.0 * FEW) / n)
    rows = rows.filter(F.when(F.col("is_long"), (F.col("short") < FEW) & below(F.col("long"))).otherwise(below(F.col("short"))))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("is_long", "h", "text"))).filter(F.col("rank") <= FEW)
    return rows.filter(F.col("is_long") | (F.col("h") > F.lit(-1 if last is None else last))).orderBy("rank", "h", "text", "lang").limit(most).select("text", "lang")


def learn(docs: DataFrame, most: int = SAMPLE) -> bytes | None:
    """A trained model (about 0.3 MB), from a bounded sample of documents that are not held out."""
    lean(docs.sparkSession)
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    first = stored(smallest_hashes(known.filter(F.octet_length("text") <= LONGEST), most, "doc_id", "text", "lang"), "sample")
    sample = first.select(F.col("text").cast("binary").alias("text"), "lang").unionByName(rare(known, first, most))

    def train(frames):
        texts, langs = [], []
        for f in frames:
            texts += f["text"].tolist()
            langs += f["lang"].tolist()
        if texts:
            x = np.empty((len(texts), DIM), np.float32)
            for a, b in groups_of(texts, 1 << 20):
                x[a:b] = features(texts[a:b])
            model = pickle.dumps(fit(x, langs))
            del x, texts
            tidy()
            yield pd.DataFrame({"model": [model]})

    rows = sample.coalesce(1).mapInPandas(train, "model binary").collect()
    return rows[0]["model"] if rows else None


def identify(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced)."""
    model = learn(docs, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        model = pickle.loads(shared.value)
        letter = regex.compile(r"\p{L}")
        for text in frames:
            texts = [None if t is None or not letter.search(t) else t.encode("utf-8", "surrogatepass") for t in text]
            out = [("und", 0.0)] * len(texts)
            ok = [i for i, t in enumerate(texts) if t is not None]
            for a, b in groups_of([texts[i] for i in ok], 1 << 20):
                for c in range(a, b, 256):
                    them = ok[c : min(b, c + 256)]
                    for i, lang, score in zip(them, *decide(model, features([texts[i] for i in them])), strict=True):
                        out[i] = (lang, float(score))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])
        tidy()

    found = unknown
    if model is not None:
        found = F.pandas_udf(predict, "struct<lang_pred:string,score:double>")(F.col("text").cast("string"))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*keep, found.alias("__cl_found")).select(*keep, "__cl_found.lang_pred", "__cl_found.score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


SQL = None
