"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are words (A-Z lower-cased, by one of ``WORDS`` hash buckets), pairs of
neighbouring bytes, folded to classes, and a few counts of repetition. A
bounded sample of labelled documents (``MAX_LABELLED`` rows, by hash of doc_id)
gives term weights, latent axes (truncated SVD) and labelled vectors; these are
broadcast, at most MAX_LABELLED * RANK + TERMS * RANK numbers whatever the
corpus. Every document is projected, its cosines with all labelled vectors are
computed exactly in blocks, and the NEIGHBOURS largest vote with their
similarity as weight.

Defined results: labels come only from rows whose crc32(doc_id as text) mod 4
isn't 2; several labels of a doc_id are averaged; all labelled vectors vote
that are as similar (to 9 decimals) as the last of the neighbours, so ties
need no order; a null or empty text, or one without neighbours, scores the
sample's mean label; without any labelled row every score is 0.5; repeated
rows score alike; a row without doc_id isn't held out and gives no label; an
empty table gives an empty result; columns other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.session import ship_package

MAX_LABELLED = 3000
RANK = 48
NEIGHBOURS = 25
POWER = 4
THRESHOLD = 0.7
BLOCK = 512
WORDS = 2048
#: Bytes that belong to a word.
WORD = re.compile(rb"[a-z\x80-\xff]+")


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            c = b - 97
        elif 65 <= b <= 90:
            c = 26
        elif 48 <= b <= 57:
            c = 27
        elif b == 32:
            c = 28
        elif b < 32:
            c = 29
        elif b in b".,":
            c = 30
        elif b in b"!?":
            c = 31
        elif b in b"#*$%&|<>":
            c = 32
        elif b < 128:
            c = 33
        else:
            c = 34 + (b & 7)
        table[b] = c
    return table


CLASS = _classes()
WIDTH = int(CLASS.max()) + 1
SHAPES = 4
TERMS = WORDS + WIDTH * WIDTH + SHAPES


def terms(data: bytes) -> np.ndarray:
    """Weights of the terms of a UTF-8 text: damped shares of words and pairs, and of repetition."""
    out = np.zeros(TERMS, np.float32)
    found = Counter(WORD.findall(data.lower()))
    if found:
        buckets = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % WORDS
        out[:WORDS] = np.sqrt(np.bincount(buckets, np.fromiter(found.values(), np.float64, len(found)), WORDS) / found.total())
    if len(data) > 1:
        c = CLASS[np.frombuffer(data, np.uint8)]
        counts = np.bincount(c[:-1] * WIDTH + c[1:], minlength=WIDTH * WIDTH)
        out[WORDS:-SHAPES] = np.sqrt(counts / len(data))
    words = data.split()
    if words:
        n = len(words)
        lines = [x for x in data.split(b"\n") if x]
        again = sum(a == b for a, b in zip(words, words[1:])) / n
        pairs = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
        same = 1 - len(set(lines)) / max(1, len(lines))
        out[-SHAPES:] = np.sqrt([again, pairs, same, min(1.0, 10 / n)])
    return out


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 7) -> dict[str, np.ndarray]:
    """Term weights, latent axes, labelled vectors of unit length, labels."""
    n = len(rows)
    weights = np.log((1 + n) / (1 + np.count_nonzero(rows, axis=0))).astype(np.float32) + 1
    weights[-SHAPES:] *= 2
    x = _unit(rows * weights)
    rank = min(rank, n, TERMS)
    axes = np.random.default_rng(seed).standard_normal((TERMS, rank)).astype(np.float32)
    for _ in range(6):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    axes = np.ascontiguousarray(axes * weights[:, None], np.float32)
    return {"axes": axes, "vectors": _unit(rows @ axes), "labels": labels.astype(np.float32), "mean": np.float32(labels.mean())}


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x, np.float32), where=size > 0).astype(np.float32)


def vote(model: dict[str, np.ndarray], rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of documents given by their terms."""
    near = (_unit(rows @ model["axes"]).astype(np.float64) @ model["vectors"].T.astype(np.float64)).round(9)
    k = min(neighbours, near.shape[1])
    last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    weight = np.where(near >= last[:, None], np.maximum(near, 0), 0) ** POWER
    total = weight.sum(axis=1)
    votes = weight @ model["labels"].astype(np.float64)
    return np.clip(np.where(total > 0, votes / np.where(total > 0, total, 1), model["mean"]), 0, 1).round(9)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms and labels of the sample; the bound is the limit."""
    marks = labels.select(F.col(f"`{doc_id}`").alias("l_id"), F.col(label).cast("double").alias("label")).filter("l_id IS NOT NULL AND label IS NOT NULL")
    marks = marks.filter(F.crc32(F.col("l_id").cast("string")) % 4 != 2).groupBy("l_id").agg(F.avg("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("l_id"), "l_id").limit(limit)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("l_id"))
    rows = rows.groupBy("l_id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from chronogeo.llm.quality_knn import terms

        for batch in batches:
            found = [terms(t.as_py() or b"").astype(np.float32).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["label", "terms"])

    table = rows.orderBy("l_id").select("label", "text").mapInArrow(run, "label double, terms binary").toArrow()
    if not table.num_rows:
        return np.zeros((0, TERMS), np.float32), np.zeros(0)
    return np.stack([np.frombuffer(x.as_py(), np.float32) for x in table["terms"]]), table["label"].to_numpy()


def score_column(text: Column, model) -> Column:
    """Score of each text; model is a broadcast variable."""

    def udf(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        from chronogeo.llm.quality_knn import BLOCK, terms, vote

        out, rows = [], texts.cast(pa.binary())
        for at in range(0, len(rows), BLOCK):
            block = np.stack([terms(t.as_py() or b"") for t in rows.slice(at, BLOCK)])
            out.append(vote(model.value, block))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(udf, "double")(text)


def scored(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", limit: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row."""
    spark = docs.sparkSession
    ship_package(spark)
    rows, marks = labelled_sample(docs, labels, text, doc_id, label, limit)
    score = score_column(F.col(text), spark.sparkContext.broadcast(fit(rows, marks))) if len(rows) else F.lit(0.5)
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
