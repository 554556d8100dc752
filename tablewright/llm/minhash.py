"""Near-duplicate documents: chosen-path joins over minwise tokens, then an exact prefix-filtered join.

A document is the set of its word shingles. First, most links are found by chance: in each of several
independent trees, a document starts at the root and is sent on to the nodes named by a few chosen
minwise tokens, so that similar sets meet in many nodes. Nodes that are small enough are compared:
first by estimates from the minwise tokens, then on the full sets. Nodes that are too large are
compared within blocks and branch again by other tokens; a child whose documents are known to be
connected already is left.

Then the links that chance missed are found without loss. All shingles have one order, in which those
frequent in a sample come last. Two sets as similar as the threshold share one of their first
shingles in it (1 - threshold of the set, and one more), so documents meet at these. Nodes whose
documents are connected already are left; from the others, only documents go that no length, place or
parity bound leaves a partner of another component, and the full sets decide. Nodes that are too large
are compared in pairs of blocks. Links that the full sets confirm are joined to components.

Defined cases: null and wordless texts have no shingles and are linked with nothing; a text with fewer
words than a shingle is one shingle; identical sets are linked through their smallest key before
any node is built, so copies cost nothing further. Repeated words and shingles count once. ``key``
must be unique; a row without one takes the component of its copies, if any, and is never kept before
them. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.bytetext import LOWER, chain, flat_words
from tablewright.llm.common import drop_stage, flat_bytes, groups_in_order, hash_bound, slices, stage
from tablewright.llm.components import components

#: Minwise tokens per document; trees; documents and shingles that a node may hold to be compared
#: exhaustively; levels of branching.
TOKENS = 64
TREES = 8
NODE_DOCS = 4_096
NODE_SHINGLES = 3_000_000
LEVELS = 3
#: Pairs whose estimate lies this much below the threshold (four standard deviations) wait for the exact join.
SLACK = 0.18
#: Documents sampled for the order of the shingles, and slots that count their shingles. Any order is
#: exact; a good one has few documents meet. Least bits of a set's parity map.
SAMPLE_DOCS = 10_000
SLOT_BITS = 23
PARITY_BITS = 1_024

_MULTIPLY = np.random.default_rng(8).integers(1, 1 << 62, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = np.ones(256, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0


def shingle_sets(values: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and ``len + 1`` offsets."""
    data, offsets = flat_bytes(values)
    hashes, rows = flat_words(data, offsets, _KIND, LOWER)
    if not len(hashes):
        return hashes, np.zeros(len(values) + 1, np.int64)
    counts = np.bincount(rows, minlength=len(values))
    whole = (rows[: -size + 1] == rows[size - 1 :]) if size > 1 else np.ones(len(rows), bool)
    long = chain([hashes[j : len(hashes) - size + 1 + j] for j in range(size)])[whole]
    long_rows = rows[: len(whole)][whole]
    few = np.flatnonzero((counts > 0) & (counts < size))  # all words of a short text are one shingle
    starts = np.searchsorted(rows, few)
    short = np.array([chain([hashes[s + j : s + j + 1] for j in range(counts[r])])[0] for s, r in zip(starts, few)], np.uint64)
    found, owner = np.concatenate([long, short]), np.concatenate([long_rows, few])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(values) + 1))


def _tokens(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minwise tokens, one row per text that has shingles."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(full), TOKENS), np.uint32)
    if not len(full):
        return out
    mixed = found ^ (found >> np.uint64(31))
    for i, m in enumerate(_MULTIPLY):
        out[:, i] = np.minimum.reduceat((mixed * m) >> np.uint64(32), offsets[full])
    return out


def _slots(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def frequent_slots(docs: DataFrame, key: str, text: str, size: int) -> np.ndarray:
    """Frequency class of each slot of shingle hashes in a sample of documents; 0 is rare."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                slots, counts = np.unique(_slots(shingle_sets(part.column(0), size)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts)], names=["slot", "docs"])

    sample = docs.filter(F.xxhash64(key) <= hash_bound(share)).select(F.col(text).alias("text")).distinct()
    counted = sample.mapInArrow(run, "slot long, docs long").groupBy("slot").agg(F.sum("docs").alias("docs")).filter("docs > 2").toArrow()
    classes = np.zeros(1 << SLOT_BITS, np.uint8)
    classes[counted.column("slot").to_numpy()] = np.log2(counted.column("docs").to_numpy()).astype(np.uint8) + 1
    return classes


def prefixes(found: np.ndarray, offsets: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First shingles of all sets in the common order, ``len + 1`` offsets, and how many are rare.

    Sets with 100 * intersection >= percent * union have an intersection of percent / 100 of either
    set at least, so that at most the rest of a set comes before their first common shingle.
    """
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kind = classes[_slots(found)]
    order = np.lexsort((found, kind, owner))
    keep = np.arange(len(found)) - offsets[owner] <= (sizes - -(-percent * sizes // 100))[owner]
    ends = np.append(0, np.cumsum(np.bincount(owner[keep], minlength=len(sizes))))
    rare = np.bincount(owner[keep], weights=kind[order][keep] == 0, minlength=len(sizes)).astype(np.int64)
    return found[order][keep], ends, rare


def parities(found: np.ndarray, offsets: np.ndarray, whole: bool) -> list[bytes]:
    """A map of bits per set: for each residue of the hashes, whether an odd number has it.

    Maps of one length differ in no more bits than the sets have shingles that are in one of them only.
    ``whole`` maps have a bit for each shingle at least, a power of two; the halves of a map fold to
    the shorter one.
    """
    sizes = np.diff(offsets)
    bits = np.full(len(sizes), PARITY_BITS, np.int64)
    if whole:
        bits = np.maximum(bits, np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    bases = np.append(0, np.cumsum(bits))
    codes = np.repeat(bases[:-1], sizes) + (found & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    codes, counts = np.unique(codes, return_counts=True)
    codes = codes[counts % 2 == 1]
    out = np.zeros(bases[-1] // 8, np.uint8)
    if len(codes):
        place = codes >> 3
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        out[place[starts]] = np.bitwise_or.reduceat(np.uint8(1) << (codes & 7).astype(np.uint8), starts)
    return [out[a:b].tobytes() for a, b in zip(bases // 8, bases[1:] // 8)]


def sketches(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Rows (key, n, digest, tokens as 32-bit numbers, prefix, rare, parity, map); no digest for empty sets."""
    schema = "key long, n long, digest binary, tokens binary, prefix array<long>, rare long, parity binary, map binary"
    shared = docs.sparkSession.sparkContext.broadcast(frequent_slots(docs, key, text, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, offsets = shingle_sets(part.column(1), size)
                tokens = iter(_tokens(found, offsets))
                digests, rows = [], []
                for start, end in zip(offsets, offsets[1:]):
                    digests.append(hashlib.blake2b(found[start:end].tobytes(), digest_size=16).digest() if end > start else None)
                    rows.append(next(tokens).tobytes() if end > start else None)
                first, ends, rare = prefixes(found, offsets, shared.value, percent)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first.view(np.int64)))
                maps = [pa.array(parities(found, offsets, whole), pa.binary()) for whole in (False, True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), pa.array(rows, pa.binary()), lists, pa.array(rare), *maps],
                    names=["key", "n", "digest", "tokens", "prefix", "rare", "parity", "map"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _branches(rows: DataFrame, threshold: float) -> DataFrame:
    """Child nodes of every row: one chosen token, or two, 1 / threshold of them on average.

    The choice depends on the node alone, so all its documents branch by the same tokens. A pair as
    similar as the threshold thus shares one child of a shared node on average.
    """
    pick = F.pmod(F.xxhash64("path", F.lit("first")), F.lit(TOKENS))
    other = F.pmod(pick + 1 + F.pmod(F.xxhash64("path", F.lit("second")), F.lit(TOKENS - 1)), F.lit(TOKENS))
    more = F.pmod(F.xxhash64("path", F.lit("more")), F.lit(10_000)) < round((1 / threshold - 1) * 10_000)
    chosen = F.when(more, F.array(pick, other)).otherwise(F.array(pick))
    out = rows.withColumn("place", F.explode(chosen))
    return out.withColumn("path", F.xxhash64("path", "place", F.substr("tokens", (F.col("place") * 4 + 1).cast("int"), F.lit(4)))).drop("place")


def _nodes(members: DataFrame) -> DataFrame:
    """Members of the nodes to compare, one node of each small set of members.

    Nodes whose documents share one label are connected already and left out. ``blocks`` is the number
    of blocks that a node is dealt into which is too large, else null.
    """
    seen = members.groupBy("path").agg(
        F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("key")).alias("who"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("too"),
    ).filter("low <> high")
    small = (F.col("docs") == 2) | ((F.col("docs") <= NODE_DOCS) & (F.col("shingles") <= NODE_SHINGLES))
    blocks = F.ceil(F.greatest(F.col("docs") / NODE_DOCS, F.col("shingles") / NODE_SHINGLES) * 2)
    kept = seen.groupBy("docs", "who", "too", F.when(~small, F.col("path")).alias("large")).agg(
        F.min("path").alias("path"), F.min(F.when(~small, blocks)).alias("blocks")
    )
    return members.join(kept.select("path", "blocks"), "path")


def _likely(tokens: np.ndarray, least: float) -> np.ndarray:
    """Members of a node that some other member resembles, by the share of equal minwise tokens."""
    n = len(tokens)
    alike = np.zeros(n, bool)
    for start in range(0, n, 128):
        block = tokens[start : start + 128]
        equal = np.zeros((len(block), n), np.uint8)
        for i in range(tokens.shape[1]):
            equal += block[:, i, None] == tokens[None, :, i]
        near = equal >= least * tokens.shape[1]
        near[np.arange(len(block)), start + np.arange(len(block))] = False
        alike[start : start + 128] = near.any(axis=1)
    return alike


def _sift(members: DataFrame, threshold: float) -> DataFrame:
    """Members (path, key) that resemble another member of their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, "path"):
            tokens = np.frombuffer(b"".join(group.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            kept = group.select(["path", "key"]).filter(pa.array(_likely(tokens, threshold - SLACK)))
            yield from kept.combine_chunks().to_batches()

    dealt = members.select("path", "key", "tokens").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(run, "path long, key long")


def confirmed_links(keys: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Components of one node under links with intersection / union >= percent / 100.

    Every document is compared with all that are not yet known to be connected to it. The result
    links each document to the smallest key of its component.
    """
    order = np.lexsort((keys, [len(s) for s in sets]))
    keys, sets = keys[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_value = np.argsort(inverse, kind="stable")
    bounds = np.searchsorted(inverse[by_value], np.arange(len(values) + 1))
    holders, offsets = owner[by_value], np.append(0, np.cumsum(sizes))
    label = np.arange(len(sets))
    for i in range(len(sets)):
        if (label == label[i]).all():
            break
        mine = inverse[offsets[i] : offsets[i + 1]]
        shared = np.zeros(len(sets), np.int64)
        lengths = bounds[mine + 1] - bounds[mine]
        first = np.repeat(bounds[mine] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
        shared += np.bincount(holders[first + np.arange(lengths.sum())], minlength=len(sets))
        near = (100 * shared >= percent * (sizes + sizes[i] - shared)) & (label != label[i])
        if near.any():
            label[np.isin(label, label[near])] = label[i]
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, label, keys)
    return [(int(k), int(m)) for k, m in zip(keys, least[label]) if k != m]


def _confirm(likely: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Edges (u, v) between likely members of a node that their full sets confirm."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, offsets = shingle_sets(part.column(1), size)
                blobs = [found[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["key", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, "path"):
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            links = confirmed_links(group.column("key").to_numpy(), sets, percent)
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    # The keys of likely documents grow with the corpus, so they are never broadcast.
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).hint("merge")
    sets = texts.join(likely.select("key").distinct(), "key").select("key", "text").mapInArrow(build, "key long, shingles binary")
    dealt = likely.hint("merge").join(sets, "key").repartition("path").sortWithinPartitions("path")
    return dealt.select("path", "key", "shingles").mapInArrow(compare, "u long, v long")


def _neighbours(edges: DataFrame) -> DataFrame:
    """Smallest node among each node and its neighbours: equal ones are connected through it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("component"))


def _pairs_of_blocks(large: DataFrame) -> DataFrame:
    """Members of large nodes in one group for each pair of blocks: every pair of members meets."""
    mine = F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = large.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    path = F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.withColumn("path", path).drop("mine", "other", "blocks")


def _meetings(reps: DataFrame, linked: DataFrame) -> DataFrame:
    """Members (path, key, n, place, label, blocks) of nodes named by a prefix shingle.

    Nodes with one label are left out. Of nodes with the same members that of the earliest shingle
    stays, for which the bound on places holds.
    """
    known = reps.select("key", "n", "prefix", "rare").join(linked.withColumnRenamed("node", "key"), "key", "left")
    columns = ["key", "n", F.coalesce("component", "key").alias("label")]
    # Most rare shingles are in one document only: a window drops them before anything is joined.
    one = Window.partitionBy("path")
    few = known.select(*columns, F.posexplode(F.slice("prefix", F.lit(1), F.col("rare").cast("int"))).alias("place", "path"))
    few = few.withColumn("low", F.min("label").over(one)).withColumn("high", F.max("label").over(one)).filter("low <> high").drop("low", "high")
    often = known.select(*columns, F.posexplode("prefix").alias("place", "path"), "rare").filter("place >= rare").drop("rare")
    members = stage(few.unionByName(often), "minhash-meetings")
    seen = members.groupBy("path").agg(
        F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("place").alias("places"),
        F.bit_xor(F.xxhash64("key")).alias("who"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("too"),
    ).filter("low <> high")
    small = (F.col("docs") == 2) | ((F.col("docs") <= NODE_DOCS) & (F.col("shingles") <= NODE_SHINGLES))
    blocks = F.when(~small, F.ceil(F.greatest(F.col("docs") / NODE_DOCS, F.col("shingles") / NODE_SHINGLES) * 2))
    kept = seen.groupBy("docs", "who", "too").agg(F.min_by(F.struct("path", blocks.alias("blocks")), "places").alias("node"))
    nodes = stage(members.join(kept.select("node.path", "node.blocks"), "path"), "minhash-exact-nodes")
    drop_stage(reps.sparkSession, members)
    return nodes


def possible(n: np.ndarray, place: np.ndarray, label: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """Members of a node that may be linked with one of another label for all that the bounds say.

    A link needs an intersection of percent / (100 + percent) of both sizes. What follows the first
    common shingle of two sets bounds it from above; so does the number of bits in which their parity
    maps differ, each of which is a shingle of one set only. Maps are folded to the shorter one.
    """
    most = (n - place) * (100 + percent) // percent - n
    lengths = np.array([len(m) for m in maps])
    folded: dict[int, np.ndarray] = {}
    for length in np.unique(lengths).tolist():
        folded[length] = np.zeros((len(n), length // 8), np.uint64)
        for i in np.flatnonzero(lengths >= length):
            folded[length][i] = np.bitwise_xor.reduce(np.frombuffer(maps[i], np.uint64).reshape(-1, length // 8), axis=0)
    out = np.zeros(len(n), bool)
    for start in range(0, len(n), 128):
        rows = slice(start, start + 128)
        near = (label[rows, None] != label) & (n <= most[rows, None]) & (n[rows, None] <= most)
        a, b = np.nonzero(near)
        a += start
        shorter = np.minimum(lengths[a], lengths[b])
        for length, words in folded.items():
            left, right = a[shorter == length], b[shorter == length]
            step = max(1, (1 << 23) // length)
            for at in range(0, len(left), step):
                i, j = left[at : at + step], right[at : at + step]
                apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
                total = n[i] + n[j]
                out[i[(100 + percent) * (total - apart) >= 2 * percent * total]] = True
    return out


def _possible(members: DataFrame, reps: DataFrame, maps: str, percent: int) -> DataFrame:
    """Members (path, key, n, place, label) that the bounds leave by the given maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, "path"):
            n, place, label = (group.column(c).to_numpy().astype(np.int64) for c in ("n", "place", "label"))
            kept = possible(n, place, label, group.column("map").to_pylist(), percent)
            if kept.any():
                yield from group.drop_columns("map").filter(pa.array(kept)).combine_chunks().to_batches()

    every = members.select("path", "key", "n", "place", "label").join(reps.select("key", F.col(maps).alias("map")), "key")
    dealt = every.select("path", "key", "n", "place", "label", "map").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(run, "path long, key long, n long, place int, label long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept): one per document.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. Copies of
    one set share a digest and are represented by the smallest key. What is shuffled are tokens,
    prefixes, and the full sets of the documents that may resemble another. Nodes that are still too
    large after ``LEVELS`` levels are left to the exact join, as is every pair that the trees miss.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    drawn = stage(sketches(docs, key, text, size, percent), "minhash-sketches")
    first = drawn.filter("n > 0").groupBy("digest").agg(F.min("key").alias("key"))
    reps = stage(drawn.join(first.select("key"), "key").select("key", "n", "tokens", "prefix", "rare", "parity", "map"), "minhash-representatives")
    tokens = reps.select("key", "tokens")
    trees = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TREES - 1).cast("long")))
    members = reps.select(trees.alias("path"), "key", "n", "tokens", F.col("key").alias("label"))
    edges, old = None, [reps]

    def compare(nodes: DataFrame) -> None:
        nonlocal edges
        likely = stage(_sift(nodes.join(tokens, "key"), threshold), "minhash-likely")
        found = stage(_confirm(likely, docs, key, text, size, percent), "minhash-links")
        old.extend([likely, found])
        edges = found if edges is None else edges.unionByName(found)

    for level in range(LEVELS):
        nodes = stage(_nodes(_branches(members, threshold).select("path", "key", "n", "label")), "minhash-nodes")
        old.append(nodes)
        block = F.xxhash64("path", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")))
        compare(nodes.select(F.when(F.col("blocks").isNull(), F.col("path")).otherwise(block).alias("path"), "key"))
        large = nodes.filter("blocks is not null")
        if large.isEmpty():
            break
        # At first the smallest neighbour will do as a label; later all that is known counts.
        known = _neighbours(edges) if level == 0 else components(edges)
        labelled = large.drop("label").join(known.withColumnRenamed("node", "key"), "key", "left")
        members = labelled.join(tokens, "key").select(
            "path", "key", "n", "tokens", "blocks", F.coalesce("component", "key").alias("label")
        )
    linked = components(edges)
    nodes = _meetings(reps, linked)
    members = nodes.filter("blocks is null").drop("blocks").unionByName(_pairs_of_blocks(nodes.filter("blocks is not null")))
    likely = stage(_possible(members, reps, "parity", percent), "minhash-possible")
    missed = stage(_possible(likely, reps, "map", percent), "minhash-missed")
    found = stage(_confirm(missed.select("path", "key"), docs, key, text, size, percent), "minhash-links")
    old += [nodes, likely, missed, found]
    if not found.isEmpty():
        linked = components(linked.toDF("u", "v").unionByName(found))
    names = drawn.select("key", "n", "digest").join(first.withColumnRenamed("key", "rep"), "digest", "left")
    done = names.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "key").alias("component_id")
    )
    for table in old:
        drop_stage(spark, table)
    return done.withColumn("kept", F.col(key) == F.col("component_id"))
