"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Words are runs of letters, digits and other non-ASCII bytes, or runs of ASCII punctuation. One- and
two-word shingles are hashed into a table of ``2 ** BITS`` weights (a word followed by itself is one
feature, whatever the word); a text is a sparse vector of
relative frequencies, and its score the logistic function of a dot product. Training takes a bounded
sample of labelled texts, deals it by hash over ``SHARDS`` tasks, runs the follow-the-regularised-leader
updates in each and averages the weights that the tasks found, round by round.

Defined cases: null and wordless texts have the zero vector and get the score of the bias; labels
other than 0 and 1 are not learned from; without labels every score is 0.5. Texts are read whole.
Repeated label rows count once. Extra columns are kept; a clashing ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.bytetext import chain, flat_words
from tablewright.llm.common import drop_stage, flat_bytes, sample_by_class, slices, stage

BITS = 18
#: Bounds of the training: labelled texts per label, tasks that train side by side, rounds of
#: averaging, and passes of a task in each round.
SAMPLE_PER_LABEL = 4_000
SHARDS = 16
ROUNDS = 2
PASSES = 2
#: FTRL-proximal: learning rate, its smoothing, and the L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.1

#: Feature of a word that follows itself.
REPEATED = np.uint64(0x5EED5EED5EED5EED)

_KIND = np.full(256, 1, np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float


def features(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the text of each: first all words, then all pairs."""
    data, offsets = flat_bytes(values)
    words, rows = flat_words(data, offsets, _KIND)
    if not len(words):
        return words.astype(np.int64), rows
    pairs = np.where(words[:-1] == words[1:], REPEATED, chain([words[:-1], words[1:]]))
    same = rows[:-1] == rows[1:]
    found = np.concatenate([words, pairs[same]]) >> np.uint64(64 - BITS)
    return found.astype(np.int64), np.concatenate([rows, rows[:-1][same]])


def margins(values: pa.Array, model: QualityModel) -> np.ndarray:
    """Sparse dot products: mean weight of the features of each text, plus the bias."""
    found, rows = features(values)
    total = np.bincount(rows, model.weights[found], len(values))
    count = np.bincount(rows, minlength=len(values))
    return total / np.maximum(count, 1) * SCALE + model.bias


#: Relative frequencies are multiplied by this, so that one pass moves the weights enough.
SCALE = 30.0


def ftrl(texts: pd.Series, labels: np.ndarray, start: QualityModel, passes: int) -> QualityModel:
    """FTRL-proximal passes over one shard, starting from given weights."""
    found, rows = features(pa.array(texts, pa.large_string()))
    order = np.argsort(rows, kind="stable")
    found, offsets = found[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))
    size = 1 << BITS
    # State that yields the starting weights: n from a first guess of the curvature, z to match.
    n = np.zeros(size + 1)
    w0 = np.append(start.weights, start.bias)
    z = -w0 * (BETA / ALPHA + L2) - np.sign(w0) * L1
    z[size] = -w0[size] * BETA / ALPHA
    strength = np.append(np.full(size, L1), 0.0)
    shrink = np.append(np.full(size, L2), 0.0)

    def weights(at: np.ndarray) -> np.ndarray:
        free = np.maximum(np.abs(z[at]) - strength[at], 0.0) * np.sign(z[at])
        return -free / ((BETA + np.sqrt(n[at])) / ALPHA + shrink[at])

    for _ in range(passes):
        for i in range(len(labels)):
            at, times = np.unique(found[offsets[i] : offsets[i + 1]], return_counts=True)
            at = np.append(at, size)
            x = np.append(times / max(1, times.sum()) * SCALE, 1.0)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    done = weights(np.arange(size + 1))
    return QualityModel(done[:size], float(done[size]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> QualityModel:
    """Averages what ``SHARDS`` tasks learn from at most ``SAMPLE_PER_LABEL`` rows of each label.

    The sample is picked from the labels by a hash of the key, so the join that fetches the texts
    broadcasts a bounded number of rows. Each task returns its weights that are not zero, and the
    average of a feature is a map-side sum.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col(label).cast("int").alias("label"), F.col(key).alias("key"))
    rows = rows.filter("label in (0, 1) and key is not null").distinct()
    picked = sample_by_class(rows, "label", "key", SAMPLE_PER_LABEL)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sample = stage(texts.join(F.broadcast(picked), "key").withColumn("shard", F.pmod("pick", F.lit(SHARDS))), "quality-sample")
    model = QualityModel(np.zeros(1 << BITS), 0.0)
    out = T.StructType([T.StructField("feature", T.LongType()), T.StructField("weight", T.DoubleType())])
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["pick", "key"])
            found = ftrl(group["text"], group["label"].to_numpy(float), shared.value, PASSES)
            w = np.append(found.weights, found.bias)
            at = np.flatnonzero(w)
            return pd.DataFrame({"feature": np.append(at, -1), "weight": np.append(w[at], 1.0)})

        rows = sample.groupBy("shard").applyInPandas(learn, out).groupBy("feature").agg(F.sum("weight").alias("total")).toPandas()
        tasks = rows.loc[rows.feature == -1, "total"].sum()
        if not tasks:
            break
        mean = np.zeros((1 << BITS) + 1)
        kept = rows[rows.feature >= 0]
        mean[kept.feature.to_numpy()] = kept.total.to_numpy() / tasks
        model = QualityModel(mean[:-1], float(mean[-1]))
    drop_stage(spark, sample)
    return model


def score(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds ``score`` between 0 and 1 to every row."""
    kept = [c for c in df.columns if c != "score"]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(QualityModel(model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                m = margins(part.column(part.schema.get_field_index(text)), shared.value)
                values = pa.array(1.0 / (1.0 + np.exp(-np.clip(m, -35, 35))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, "score"])

    return df.select(*kept).mapInArrow(run, schema)
