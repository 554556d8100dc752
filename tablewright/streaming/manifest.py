"""A cleaned folder that follows its files: added, replaced and deleted ones, found by a manifest.

Below the target lie ``rows/version=N`` (cleaned rows with their file), ``rejects/version=N`` and
``manifest/version=N`` (one row per file: path, length, time, content digest, and the version that
holds its rows). A run only adds a version, and its manifest is written last. So a run that fails
leaves the former state readable, and its repetition replaces its own output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import SOURCE_FILE, column
from tablewright.functions import constants as K
from tablewright.plans.plan import Plan
from tablewright.plans.rules import CELL_ACTIONS, SHAPE_ACTIONS, RuleError
from tablewright.runner import clean_table, stage
from tablewright.sinks.publish import PublishError, without_identity
from tablewright.sources.inventory import inventory, metadata_path
from tablewright.streaming.incremental import new_rows

# Rules that judge one row at a time: the result of a file does not depend on the other files.
ROW_LOCAL = (*CELL_ACTIONS, *SHAPE_ACTIONS, "drop_empty_rows")
MANIFEST = "path string, length bigint, modified timestamp, digest decimal(38,0), held_by bigint"


@dataclass(frozen=True)
class Synced:
    """What a run found: (path, change), with change 'added', 'replaced', 'touched' or 'deleted'."""

    version: int
    changes: DataFrame


def content_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, digest) of text files from one pass; the order of lines counts, no line is shuffled.

    In a block of a file each line's hash is weighted with its place. Row numbers of a task start
    anywhere, so the sums are shifted to begin at the block's first line. A block is named by its
    first byte: other block sizes give other digests, and so at worst a file is cleaned again.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(paths).select(
        metadata_path().alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        # 50 bits, so that no sum of a block overflows however many lines are equal.
        F.shiftrightunsigned(F.xxhash64("value"), 14).cast("decimal(16,0)").alias("hash"),
        place.cast("decimal(10,0)").alias("place"),
    )
    blocks = lines.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("hash").alias("hashes"),
        F.sum(F.col("hash") * F.col("place")).alias("weighted"),
        F.min("place").alias("first"),
    )
    shifted = F.col("weighted") - F.col("first") * F.col("hashes").cast("decimal(27,0)")
    block = F.xxhash64("block", "n", F.col("hashes").cast("string"), shifted.cast("decimal(38,0)").cast("string"))
    return blocks.groupBy("path").agg(F.sum(block.cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest"))


def _latest(spark: SparkSession, target: str) -> int | None:
    """The last version whose manifest is complete."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    versions = [int(status.getPath().getParent().getName().split("=")[1]) for status in found or []]
    return max(versions, default=None)


def manifest(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """(path, length, modified, digest, held_by) of the last or a given version; empty before the first."""
    target = target.rstrip("/")
    version = _latest(spark, target) if version is None else version
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest/version={version}")


def read_synced(spark: SparkSession, target: str, schema: T.StructType | str, version: int | None = None) -> DataFrame:
    """The rows of the files that are there now, or were in a given version, with ``_source_file``.

    ``schema`` is that of the cleaned rows. Only versions that still hold a file's rows are read.
    """
    held = manifest(spark, target, version).filter("held_by is not null")
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([T.StructField(SOURCE_FILE, T.StringType()), *wanted.fields])
    # A few numbers, not one per file.
    versions = [r[0] for r in held.select("held_by").distinct().collect()]
    if not versions:
        return spark.createDataFrame([], full)
    named = T.StructType([*full.fields, T.StructField("version", T.LongType())])
    rows = spark.read.schema(named).parquet(f"{target.rstrip('/')}/rows").filter(F.col("version").isin(versions))
    keep = held.select(F.col("path").alias(SOURCE_FILE), F.col("held_by").alias("version"))
    return rows.join(keep, [SOURCE_FILE, "version"], "left_semi").select(*[column(f.name) for f in full.fields])


def sync_folder(
    spark: SparkSession, folder: str, schema: T.StructType | str, plan: Plan, target: str
) -> Synced:
    """Bring the cleaned rows of a folder of text files up to its present files.

    A file of the same length and time is taken as unchanged. Of the others the content is hashed:
    an equal digest means that the file was only touched, else it is cleaned again and its former
    rows are no longer read. Rows of deleted files are no longer read either. Files that do not fit
    ``schema`` and rows that break it go to the rejects, as in ``clean_new_files``; such a file is in
    the manifest all the same and is not tried again before it changes. Empty files hold no rows.
    The plan must be row-local: what a file yields may not depend on the others.
    """
    for rule in plan.applied:
        if rule.action not in ROW_LOCAL:
            raise RuleError(f"{rule.action} looks at other rows and cannot follow a folder file by file")
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    target = target.rstrip("/")
    last = _latest(spark, target)
    version = 0 if last is None else last + 1
    before = manifest(spark, target, last)
    now = inventory(spark, folder, suffixes=K.TEXT_SUFFIXES, exclude=[target]).select("path", "length", "modified")
    old = before.select("path", *[F.col(n).alias(f"old_{n}") for n in ("length", "modified", "digest", "held_by")])
    same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    joined = stage(
        now.withColumn("_here", F.lit(True)).join(old.withColumn("_known", F.lit(True)), "path", "full_outer")
        .withColumn("_same", F.coalesce(same & F.col("_here") & F.col("_known"), F.lit(False))),
        "listing",
    )
    # One record per file that is new or has another length or time, like a listing.
    suspects = [r.path for r in joined.filter("_here and not _same and length > 0").select("path").collect()]
    digests = content_digests(spark, suspects) if suspects else spark.createDataFrame([], "path string, digest decimal(38,0)")
    digest = F.when(F.col("_same"), F.col("old_digest")).otherwise(F.coalesce("digest", F.lit(0).cast("decimal(38,0)")))
    change = (
        F.when(F.col("_here").isNull(), "deleted")
        .when(F.col("_known").isNull(), "added")
        .when(F.col("_same"), F.lit(None))
        .when((F.col("length") == F.col("old_length")) & (F.col("new_digest") == F.col("old_digest")), "touched")
        .otherwise("replaced")
    )
    judged = stage(
        joined.join(digests, "path", "left").withColumn("new_digest", digest).withColumn("change", change), "changes"
    )
    redo = F.col("change").isin("added", "replaced")
    paths = [r.path for r in judged.filter(redo & (F.col("length") > 0)).select("path").collect()]
    if paths:
        _clean_version(spark, paths, wanted, plan, target, version)
    holder = F.when(F.col("length") > 0, F.lit(version).cast("long"))
    held_by = F.when(F.coalesce(redo, F.lit(False)), holder).otherwise(F.col("old_held_by"))
    judged.filter("_here").select(
        "path", "length", "modified", F.col("new_digest").alias("digest"), held_by.alias("held_by")
    ).write.mode("overwrite").parquet(f"{target}/manifest/version={version}")
    return Synced(version, judged.filter("change is not null").select("path", "change"))


def _clean_version(
    spark: SparkSession, paths: list[str], schema: T.StructType, plan: Plan, target: str, version: int
) -> None:
    """Clean some files and store their rows and rejects under one version."""
    rows, refused = new_rows(spark, paths, schema)
    refused.write.mode("overwrite").parquet(f"{target}/rejects/version={version}")
    if rows is None:
        # The version exists, without rows.
        spark.createDataFrame([], f"{SOURCE_FILE} string").write.mode("overwrite").parquet(f"{target}/rows/version={version}")
        return
    outcome = clean_table(rows, plan, staged=True)
    if not outcome.validation.valid:
        raise PublishError(f"version {version} is not valid: {'; '.join(outcome.validation.errors)}")
    kept = outcome.cleaned
    names = without_identity(kept).columns
    kept.select(column(SOURCE_FILE), *[column(n) for n in names]).write.mode("overwrite").parquet(
        f"{target}/rows/version={version}"
    )
