"""What lies in a folder, and which files can be read at all."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.sources.headers import IngestError


def canonical_path(path: Column) -> Column:
    """One spelling for local paths, which Spark writes with one or three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def file_path(url: Column) -> Column:
    """The path of a file from its URL form."""
    return canonical_path(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))))


def metadata_path() -> Column:
    """The path of the file a row comes from; Spark keeps it in URL form there."""
    return file_path(F.col("_metadata.file_path"))


def inventory(
    spark: SparkSession,
    paths: str | Sequence[str],
    suffixes: Sequence[str] = K.BATCH_SUFFIXES,
    exclude: Sequence[str] = (),
    most_workbook_bytes: int | None = None,
) -> DataFrame:
    """(path, suffix, length, modified, problem) of all files, recursively.

    Only listings are read, never contents. ``exclude`` names folders (such as the output folder)
    whose files are left out. A workbook is parsed by one task, so a caller may refuse those above
    ``most_workbook_bytes``.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(wanted)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise IngestError(f"not found: {wanted}") from error
        raise
    filled = files.select(
        canonical_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified")
    )
    # A scan leaves out files without content, so those come from the listing itself.
    names = [(unquote(path),) for path in files.inputFiles()]
    every = spark.createDataFrame(names, "path string").select(canonical_path(F.col("path")).alias("path"))
    empty = every.join(filled, "path", "left_anti").select(
        "path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified")
    )
    listed = (
        filled.unionByName(empty)
        .select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "length", "modified")
        .filter(F.col("suffix").isin(*suffixes))
    )
    for folder in exclude:
        bare = "file:///" + folder.strip("/") if "://" not in folder else folder.rstrip("/")
        listed = listed.filter(~F.startswith("path", F.lit(bare + "/")))
    problem = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("suffix") == ".xls", "legacy workbooks are not supported")
        .when(
            F.col("suffix").isin(*K.WORKBOOK_SUFFIXES) & (F.col("length") > F.lit(most_workbook_bytes)),
            "workbook is too large",
        )
        .when(~F.col("suffix").isin(*K.TEXT_SUFFIXES, *K.WORKBOOK_SUFFIXES), "unsupported file type")
    )
    return listed.withColumn("problem", problem)


def by_table(files: DataFrame, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """The rows of :func:`inventory` with one row for each table that is a folder of part files.

    A folder below ``folder`` whose name ends like a file is one table, as Spark writes them: lengths
    add up, and it is empty only if all of its files are.
    """
    inside = re.sub(r"^[A-Za-z][\w+.-]*:/*|^/+", "", folder).rstrip("/")
    names = rf"[^/].*?(?:{'|'.join(re.escape(suffix) for suffix in suffixes)})(?=/|$)"
    table = F.coalesce(
        # A folder that is spelled in another way than its files is looked for from the start of the path.
        *[F.nullif(F.regexp_extract("path", pattern, 0), F.lit("")) for pattern in (rf"(?i)^.*?/\Q{inside}\E/{names}", rf"(?i)^{names}")],
        "path",
    )
    filled = F.col("length") > 0
    return files.groupBy(table.alias("path")).agg(
        F.max("suffix").alias("suffix"), F.sum("length").alias("length"), F.max("modified").alias("modified"),
        F.coalesce(F.max(F.when(filled, F.col("problem"))), F.when(F.sum("length") == 0, F.max("problem"))).alias("problem"),
    )
