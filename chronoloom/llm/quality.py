"""A factorisation machine for document quality.

Inputs: hashed words (shares of the text), statistics of its structure, and the recorded length.  Each input has a weight and a vector of `rank` numbers; pairs
interact by the product of their vectors, summed in linear time as half of (sum of v x) squared less the sum of (v x) squared.  Trained with logistic loss in one task
on at most `most` labelled rows that are not held out, chosen by hash; every text is scored whole.

Defined results: a null text is an empty one and is scored; labels that are null or whose document is missing are not learned from; of several labels of one
doc_id each is a case; where nothing could be learned the score is 0.5; a null doc_id is not held out; an empty table gives an empty result; other columns are not read.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, groups_of, lean, smallest_hashes, word_hashes
from .langid import held_out

DIM = 1 << 15
RANK = 8
#: Labelled rows learned from, at most, and bytes of each sampled text.
SAMPLE = 8000
LONGEST = 40_000
THRESHOLD = 0.7
STATS = 20

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 line end, 6 common punctuation, 7 symbol, 8 beyond ASCII
for _k, _chars in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, (32, 9)), (5, (10, 13)), (6, b".,;:?'\"()-"), (7, b"!#$%&*+/<=>@[\\]^_`{|}~"), (8, range(128, 256))):
    _CLASS[list(_chars)] = _k


def inputs(texts: list[bytes], n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of all texts (text, word, share) and the statistics of each text."""
    m = len(texts)
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size + 1)
    h, s, e = word_hashes(joined)
    doc = np.searchsorted(end, s, side="right")
    words = np.bincount(doc, minlength=m)
    key, count = np.unique(doc.astype(np.int64) * DIM + (h & np.uint64(DIM - 1)).astype(np.int64), return_counts=True)
    row, word = key // DIM, key % DIM
    share = (count / np.maximum(words[row], 1)).astype(np.float32)
    kind = _CLASS[joined].astype(np.int64)
    of = np.repeat(np.arange(m), size + 1)
    kinds = np.bincount(of * 9 + kind, minlength=9 * m).reshape(m, 9).astype(np.float64)
    kinds[:, 5] -= 1  # the joint
    n = np.maximum(size, 1)[:, None]
    length = np.bincount(doc, weights=e - s, minlength=m)
    distinct = np.bincount(row, minlength=m)
    most = np.zeros(m)
    np.maximum.at(most, row, share)
    squares = np.bincount(row, weights=share.astype(np.float64) ** 2, minlength=m)
    same = np.bincount(doc[1:], weights=(h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=m)
    upper_first = np.bincount(doc, weights=kind[s] == 1, minlength=m)
    upper_last = np.bincount(doc, weights=kind[e - 1] == 1, minlength=m)
    odd_last = np.bincount(doc, weights=kind[e - 1] == 7, minlength=m)
    w = np.maximum(words, 1)
    lines, repeated = np.zeros(m), np.zeros(m)
    for i, t in enumerate(texts):
        rows = [x for x in t.split(b"\n") if x.strip()]
        lines[i], repeated[i] = len(rows), 1 - len(set(rows)) / max(1, len(rows))
    told = np.array([0.0 if c is None or c != c else float(c) for c in n_chars])
    stats = np.column_stack(
        [kinds[:, 1:9] / n, np.log1p(size) / 10, np.log1p(words) / 8, length / w / 10, distinct / w, most, np.sqrt(squares), same / w, upper_first / w, upper_last / w, odd_last / w, repeated,
         np.log1p(np.maximum(told, 0)) / 10]
    )
    assert stats.shape[1] == STATS
    return row, word, share, stats.astype(np.float32)


def forward(p: dict, row, word, share, stats) -> tuple[np.ndarray, np.ndarray]:
    m = len(stats)
    x = share * p["scale"]
    lin = np.bincount(row, weights=p["w"][word] * x, minlength=m) + stats @ p["u"] + p["b"]
    vx = p["v"][word] * x[:, None]
    total = np.empty((m, RANK))
    for f in range(RANK):
        total[:, f] = np.bincount(row, weights=vx[:, f], minlength=m)
    total += stats @ p["s"]
    squares = np.bincount(row, weights=(vx**2).sum(1), minlength=m) + (stats**2) @ (p["s"] ** 2).sum(1)
    return lin + 0.5 * ((total**2).sum(1) - squares), total


def fit(texts: list[bytes], n_chars: list, y: np.ndarray, epochs: int = 12) -> dict:
    """Adagrad on logistic loss with a quadratic penalty; statistics are standardised, which is folded into the model."""
    parts = [inputs(texts[a:b], n_chars[a:b]) + (a,) for a, b in groups_of(texts, 1 << 20)]
    row = np.concatenate([r + a for r, _, _, _, a in parts])
    word, share, stats = (np.concatenate([q[i] for q in parts]) for i in (1, 2, 3))
    mean, dev = stats.mean(0), stats.std(0) + 1e-3
    rng = np.random.default_rng(8)
    p = {"w": np.zeros(DIM, np.float32), "v": (rng.standard_normal((DIM, RANK)) * 0.01).astype(np.float32), "u": np.zeros(STATS), "s": rng.standard_normal((STATS, RANK)) * 0.05, "b": 0.0,
         "scale": np.float32(4.0), "mean": mean, "dev": dev}
    g2 = {k: np.full_like(np.asarray(v, np.float64), 1e-3) for k, v in p.items() if k in "wvusb"}
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    z = np.clip((stats - mean) / dev, -6, 6).astype(np.float32)

    def step(name, grad, at=slice(None), rate=0.1):
        g2[name][at] += grad**2
        if np.ndim(p[name]):
            p[name][at] -= (rate * grad / np.sqrt(g2[name][at])).astype(p[name].dtype)
        else:
            p[name] = float(p[name] - rate * grad / np.sqrt(g2[name]))

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 128):
            batch = np.sort(order[a : a + 128])
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            r = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
            wd, sh, st = word[take], share[take], z[batch].astype(np.float64)
            out, total = forward(p, r, wd, sh, st)
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[batch]) / len(batch)
            x = sh * p["scale"]
            at, where = np.unique(wd, return_inverse=True)
            gw = np.bincount(where, weights=err[r] * x, minlength=len(at)) + 1e-5 * p["w"][at]
            inner = (err[r] * x)[:, None] * (total[r] - p["v"][wd] * x[:, None])
            gv = np.stack([np.bincount(where, weights=inner[:, f], minlength=len(at)) for f in range(RANK)], 1) + 1e-5 * p["v"][at]
            gs = st.T @ (err[:, None] * total) - (st**2 * err[:, None]).sum(0)[:, None] * p["s"] + 1e-4 * p["s"]
            step("w", gw, at)
            step("v", gv, at, 0.03)
            step("u", st.T @ err + 1e-4 * p["u"])
            step("s", gs, rate=0.03)
            step("b", np.float64(err.sum()), at=())
    return p


def scores(p: dict, texts: list[bytes], n_chars: list) -> np.ndarray:
    row, word, share, stats = inputs(texts, n_chars)
    z = np.clip((stats - p["mean"]) / p["dev"], -6, 6)
    return 1 / (1 + np.exp(-np.clip(forward(p, row, word, share, z)[0], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> bytes | None:
    lean(docs.sparkSession)
    chosen = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    chosen = smallest_hashes(chosen, most, "doc_id", "quality")  # `most` rows at most: small enough to broadcast
    texts = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).select("doc_id", F.col("text").cast("binary").alias("text"), "n_chars")

    def train(frames):
        f = pd.concat(list(frames) or [pd.DataFrame({"text": [], "n_chars": [], "quality": []})])
        if len(f):
            f = f.sort_values("h", kind="stable")
            yield pd.DataFrame({"model": [pickle.dumps(fit([t or b"" for t in f["text"]], f["n_chars"].tolist(), f["quality"].to_numpy(float)))]})

    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "n_chars", "quality", F.xxhash64("doc_id", "text").alias("h"))
    rows = smallest_hashes(rows, most, "h")  # a doc_id that repeats brings no more
    got = rows.coalesce(1).mapInPandas(train, "model binary").collect()
    return got[0]["model"] if got else None


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, n_chars, ...) with a score from 0 to 1."""
    model = learn(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        p = pickle.loads(shared.value)
        for text, n_chars in frames:
            texts = [t or b"" for t in text]
            chars = n_chars.tolist()
            yield pd.Series(np.concatenate([scores(p, texts[a:b], chars[a:b]) for a, b in groups_of(texts, 1 << 21)]) if texts else [], dtype=float)

    found = F.lit(0.5) if model is None else F.pandas_udf(predict, "double")(F.col("text").cast("binary"), F.col("n_chars").cast("double"))
    return docs.select(*[c for c in docs.columns if c != "score"], found.alias("score"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    out = score(docs, documents(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL = None
