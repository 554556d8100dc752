"""Near-duplicate vectors by product quantisation with inverted lists, table lookups and exact rerank.

Vectors are scaled to length one. A coarse quantiser deals them into inverted lists; what is left after
taking off the centre of the list is coded by one number per subspace. For a query, tables hold the
distance of each of its subvectors to each code, so a list is scanned by lookups alone; what may lie
within reach is compared again by the exact cosine in double precision.

No link is lost to quantisation: a list is probed unless its cell lies farther away than a link can
reach, and a coded vector is passed on if its estimate is within reach plus its own coding error.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without a
label, link with nothing; so do vectors of different lengths. Equal vectors of one label are one row
of the index with a count. ``key`` must be unique; a row without one gets the links of its equals, if
there are any, and links nothing itself. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import drop_stage, groups_in_order, hash_bound, stage
from tablewright.llm.components import components

#: Bounds of the fit: sampled vectors, inverted lists, codes per subspace, subspaces, rounds.
SAMPLE = 20_000
LISTS = 256
CODES = 64
SUBSPACES = 8
ROUNDS = 8
#: Vectors of one list that one group holds; longer lists are cut into blocks that all meet.
BLOCK = 2_048


@dataclass(frozen=True)
class Index:
    """Centres of the lists (lists x d) and code books (subspaces x codes x d / subspaces)."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from a random start; an empty cell keeps its centre."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        cell = _squared(rows, centres).argmin(1)
        count = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, rows)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def fit(rows: np.ndarray) -> Index:
    """Quantisers from a bounded sample of unit vectors; dimensions are padded to whole subspaces."""
    rng = np.random.default_rng(17)
    lists = int(min(LISTS, max(1, np.sqrt(len(rows)))))
    centres = _means(rows, lists, rng)
    rest = rows - centres[_squared(rows, centres).argmin(1)]
    books = [_means(part, CODES, rng) for part in np.split(rest, SUBSPACES, axis=1)]
    return Index(centres, np.stack(books))


def encode(rows: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and coding error (distance to the decoded vector) of each row."""
    cell = _squared(rows, index.centres).argmin(1)
    rest = rows - index.centres[cell]
    parts = np.split(rest, SUBSPACES, axis=1)
    codes = np.stack([_squared(p, b).argmin(1) for p, b in zip(parts, index.books)], axis=1).astype(np.uint8)
    decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(index.books)], axis=1)
    return cell, codes, np.sqrt(((rest - decoded) ** 2).sum(1))


def probes(rows: np.ndarray, index: Index, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, list) such that the list may hold a vector within ``reach`` of the row.

    A vector of another cell lies beyond the plane halfway between both centres, and the distance of
    the row from that plane is half the difference of the squared distances over the centres' distance.
    """
    near = _squared(rows, index.centres)
    own = near.argmin(1)
    apart = np.sqrt(_squared(index.centres, index.centres))[own]
    beyond = (near - near[np.arange(len(rows)), own][:, None]) / np.maximum(2 * apart, 1e-12)
    return np.nonzero((beyond <= reach + 1e-6) | (apart < 1e-9))


def lookups(query: np.ndarray, centre: np.ndarray, codes: np.ndarray, index: Index) -> np.ndarray:
    """Squared distances (queries x coded vectors) as sums of table entries."""
    out = np.zeros((len(query), len(codes)))
    for i, part in enumerate(np.split(query - centre, SUBSPACES, axis=1)):
        out += _squared(part, index.books[i])[:, codes[:, i]]
    return out


def _spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest node of its component) after links (a, b) join components."""
    while True:
        of_a, of_b = label[a], label[b]
        if (of_a == of_b).all():
            return label
        np.minimum.at(label, np.maximum(of_a, of_b), np.minimum(of_a, of_b))
        while (label != label[label]).any():
            label = label[label]


def _unit(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows that can link: label, vector as doubles, smallest key and number of its copies."""
    v = F.col("v")
    clean = df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = clean.filter("key is not null and label is not null and v is not null").filter(finite & F.exists(v, lambda x: x != 0))
    # -0.0 and 0.0 are one number here
    clean = clean.withColumn("v", F.transform(v, lambda x: x + F.lit(0.0)))
    return clean.groupBy("label", "v").agg(F.min("key").alias("key"), F.count("*").alias("times"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _scaled(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _padded(rows: np.ndarray) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % SUBSPACES)))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """Rows (key, n_links, component_id, kept): one per vector.

    Two vectors of one label are linked if their cosine reaches the bound. ``n_links`` counts linked
    vectors, copies included; they are counted block by block, and of the links of a block only a
    spanning forest leaves the task.
    """
    spark = df.sparkSession
    rows = stage(_unit(df, key, vector, label), "pq-vectors")
    parts = []
    for (width,) in rows.select(F.size("v")).distinct().collect():
        one = rows.filter(F.size("v") == width)
        share = min(1.0, 1.2 * SAMPLE / max(1, one.count()))
        sample = one.filter(F.xxhash64("key") <= hash_bound(share)).select("v").toPandas()
        parts.append(_links(one, fit(_padded(_scaled(np.stack(sample["v"].to_numpy())))), width, cosine))
    if not parts:
        found = spark.createDataFrame([], "key long, links long, u long, v long")
    else:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
    found = stage(found, "pq-links")
    linked = components(found.filter("u is not null").select("u", "v"))
    counts = found.filter("links is not null").groupBy("key").agg(F.sum("links").alias("links"))
    known = rows.select("label", "v", F.col("key").alias("rep"), "times").join(counts.withColumnRenamed("key", "rep"), "rep", "left").join(
        linked.withColumnRenamed("node", "rep"), "rep", "left"
    )
    members = df.select(F.col(key), F.col(label).alias("label"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    # Digests join what would else compare whole vectors.
    digest = F.xxhash64("label", "v")
    known = known.withColumn("digest", digest).select(
        "digest", F.col("label").alias("_label"), F.col("v").alias("_v"), "rep",
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("component"),
    )
    members = members.withColumn("digest", digest)
    same = (members["digest"] == known["digest"]) & (members["label"] == known["_label"]) & (members["v"] == known["_v"])
    done = members.join(known, same, "left").select(
        F.col(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col(key).cast("long")).alias("component_id")
    )
    return done.withColumn("kept", F.col(key) == F.col("component_id"))


def _links(rows: DataFrame, index: Index, width: int, cosine: float) -> DataFrame:
    """Rows (key, links) and (u, v): counts of linked vectors per key and block, and spanning links."""
    spark = rows.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _padded(_scaled(_matrix(batch.column(batch.schema.get_field_index("v")), width)))
            cell, codes, error = encode(unit, shared.value)
            row, list_ = probes(unit, shared.value, reach)
            n = batch.num_rows
            take = np.concatenate([np.arange(n), row])
            base = batch.select(["label", "key", "times", "v"]).take(pa.array(take))
            listed = np.arange(len(take)) < n
            coded = pa.array([codes[i].tobytes() if k < n else None for k, i in enumerate(take)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*base.columns, pa.array(np.concatenate([cell, list_]), pa.int32()), pa.array(listed), coded, pa.array(np.where(listed, error[take], 0.0))],
                names=["label", "key", "times", "v", "list", "listed", "codes", "error"],
            )

    kind = dict(rows.dtypes)["label"]
    dealt = rows.select("label", "key", "times", "v").mapInArrow(
        deal, f"label {kind}, key long, times long, v array<double>, list int, listed boolean, codes binary, error double"
    )
    dealt = stage(dealt, "pq-lists")
    sizes = dealt.groupBy("label", "list").agg(
        F.ceil(F.count_if("listed") / BLOCK).alias("list_blocks"), F.ceil(F.count_if(~F.col("listed")) / BLOCK).alias("query_blocks")
    ).filter("list_blocks > 0 and query_blocks > 0")
    keyed = dealt.join(sizes, ["label", "list"])
    mine = F.pmod(F.xxhash64("key"), F.when(F.col("listed"), F.col("list_blocks")).otherwise(F.col("query_blocks")))
    others = F.when(F.col("listed"), F.col("query_blocks")).otherwise(F.col("list_blocks"))
    met = keyed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    spot = F.xxhash64("label", "list", F.when(F.col("listed"), F.col("mine")).otherwise(F.col("other")), F.when(F.col("listed"), F.col("other")).otherwise(F.col("mine")))
    met = met.select(spot.alias("spot"), "key", "times", "v", "list", "listed", "codes", "error")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, "spot"):
            links = _compare(group, shared.value, width, cosine, reach)
            if links is not None:
                yield links

    return met.repartition("spot").sortWithinPartitions("spot").mapInArrow(compare, "key long, links long, u long, v long")


def _compare(group: pa.Table, index: Index, width: int, cosine: float, reach: float) -> pa.RecordBatch | None:
    """Scans one block of a list for one block of queries."""
    listed = group.column("listed").to_numpy()
    if listed.all() or not listed.any():
        return None
    keys, times = group.column("key").to_numpy(), group.column("times").to_numpy()
    unit = _scaled(_matrix(group.column("v"), width))
    error = group.column("error").to_numpy()
    at, query = np.flatnonzero(listed), np.flatnonzero(~listed)
    codes = np.frombuffer(b"".join(group.column("codes").filter(pa.array(listed)).to_pylist()), np.uint8).reshape(-1, SUBSPACES)
    centre = index.centres[group.column("list")[0].as_py()]
    ids, place = np.unique(keys, return_inverse=True)
    label, counts = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    bound = (reach + error[at] + 1e-9) ** 2
    for start in range(0, len(query), 256):
        some = query[start : start + 256]
        likely = lookups(_padded(unit[some]), centre, codes, index) <= bound
        for i, j in zip(*_batches(*np.nonzero(likely))):
            near = np.einsum("ij,ij->i", unit[some[i]], unit[at[j]]) >= cosine
            near &= keys[some[i]] != keys[at[j]]
            a, b = place[some[i[near]]], place[at[j[near]]]
            np.add.at(counts, a, times[at[j[near]]])
            if (label[a] != label[b]).any():
                label = _spanning(label, a, b)
    full, tied = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(ids)))
    none = [None]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[full].tolist() + none * len(tied), pa.int64()), pa.array(counts[full].tolist() + none * len(tied), pa.int64()),
            pa.array(none * len(full) + ids[tied].tolist(), pa.int64()), pa.array(none * len(full) + ids[label[tied]].tolist(), pa.int64()),
        ],
        names=["key", "links", "u", "v"],
    )


def _batches(i: np.ndarray, j: np.ndarray, size: int = 100_000) -> tuple[list[np.ndarray], list[np.ndarray]]:
    cuts = range(size, len(i), size)
    return np.split(i, cuts), np.split(j, cuts)
