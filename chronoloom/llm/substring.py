"""Substring dedup on words: passages of `window` words that start anywhere else are cut out of every document.

Method: super-k-mer partitioning (windows.py).  Defined results: a null or empty text, and a text of fewer than `window` words, keeps
everything; repeated rows count as "elsewhere" for each other; windows are judged on the input; a null doc_id is kept as null and is one more row;
whitespace is normalised to one space in what is kept; an empty table gives an empty result; extra columns pass through `remove`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, stored, thinned
from .windows import covered, normal, repeated_windows

WINDOW = 35
GRAM = 6
NULL_ID = -(1 << 63)


def keys_of(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """The id and the tag that together name a row (rows that are alike in both columns share them), and the row's text: a row without an id is named by 128 bits of its text's hashes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text, F.lit("no id"))), F.xxhash64(text, F.col(id_col).isNull()), text


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (keys_of), text as bytes, named (whether there is an id)."""
    lean(docs.sparkSession)
    i, tag, text = keys_of(id_col, text_col)
    return docs.select(i.alias("doc_id"), tag.alias("tag"), text.cast("binary").alias("text"), F.col(id_col).isNotNull().alias("named"))


def touched(docs: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """docs that have spans, joined with them.  Few texts of other documents travel: a bitmap of the ids thins them out first."""
    by = ["doc_id", "tag"]
    lists = stored(spans.groupBy(*by).agg(F.collect_list("spans").alias("spans")), "span-lists")
    docs = thinned(docs, lists, by)
    return docs.join(lists.withColumnRenamed("doc_id", "_d").withColumnRenamed("tag", "_t"), (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_t"))).select(*columns, "spans")


def spans_of(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    return stored(repeated_windows(keyed(docs), window, min(gram, window), True, False), "word-spans")


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text, ...) with text replaced by its kept words where some were removed; adds n_words, n_removed."""
    spans = spans_of(docs, window, gram)
    names = docs.columns
    i, tag, _ = keys_of("doc_id", "text")
    base = docs.withColumn("__cl_id", i).withColumn("__cl_tag", tag)
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_list("spans").alias("__cl_spans")).select(F.col("doc_id").alias("__cl_d"), F.col("tag").alias("__cl_t"), "__cl_spans")
    joined = base.join(lists, (F.col("__cl_id") == F.col("__cl_d")) & (F.col("__cl_tag") == F.col("__cl_t")), "left")

    @F.pandas_udf("struct<text:string,n_words:bigint,n_removed:bigint>")
    def apply(text, spans):
        import pandas as pd

        out = []
        for t, s in zip(text, spans, strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            if s is None or not len(s):
                out.append((t, len(words), 0))
                continue
            gone = covered(list(s), len(words), window)
            out.append((b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "replace"), len(words), int(gone.sum())))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    done = joined.withColumn("__cl_new", apply("text", "__cl_spans"))
    return done.select(*[F.col("__cl_new.text").alias("text") if c == "text" else F.col(c) for c in names], "__cl_new.n_words", "__cl_new.n_removed")


def report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    base, spans = keyed(docs), spans_of(docs, window, gram)

    def plain(batches):
        for b in batches:
            n, sha = [], []
            for t in b.column(2).to_pylist():
                t = normal(t, True)
                n.append(t.count(b" ") + 1 if t else 0)
                sha.append(hashlib.sha256(t).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "tag", "named", "n_words", "sha"])

    def drop(batches):
        for b in batches:
            n, sha = [], []
            for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = t.split()
                gone = covered(s, len(words), window)
                n.append(int(gone.sum()))
                kept = np.flatnonzero(~gone).tolist()
                sha.append(hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["_d", "_t", "n_removed", "kept"])

    whole = base.mapInArrow(plain, "doc_id bigint, tag bigint, named boolean, n_words bigint, sha string")
    changed = touched(base, spans, ["doc_id", "tag", "text"]).mapInArrow(drop, "_d bigint, _t bigint, n_removed bigint, kept string").dropDuplicates(["_d", "_t"])
    out = whole.join(changed, (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_t")), "left")
    return out.select(
        F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "n_words",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
rep AS (SELECT md5(s) AS h FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT r, i FROM win JOIN rep ON md5(s) = h),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM hit),
g AS (SELECT r, list(j) AS js, count(*) AS n FROM cov GROUP BY 1),
one AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM w JOIN g USING (r)),
kept AS (SELECT r, string_agg(w[o.j], ' ' ORDER BY o.j) AS k FROM one o LEFT JOIN cov c USING (r, j) WHERE c.j IS NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k, '') END) AS kept_sha256 FROM w LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""
