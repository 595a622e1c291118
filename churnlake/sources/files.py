"""File sources and sinks: CSV scan, file facts, Parquet tables and the
date-partitioned prediction snapshot.

All locations are Hadoop paths (``s3a://``, ``abfss://``, ``hdfs://`` or a
shared mount); writes go through Spark's commit protocol, so a lost
executor's task is simply retried and never leaves partial output behind.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT_COLUMN = "_corrupt_record"
# Bound on rows per written file, so per-file byte checksums stay small.
MAX_RECORDS_PER_FILE = 250_000


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Header CSV that keeps leading/trailing blanks (they are data here)."""
    (df.write.mode(mode).option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).csv(path))
    return path


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Explicit schema, PERMISSIVE mode: malformed lines land in
    ``_corrupt_record`` instead of failing the scan."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COLUMN, T.StringType())])
    return (spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT_COLUMN).csv(path))


def file_facts(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """Per file: name, size, modification time, rows, and an MD5 content tag
    (like an object store's ETag for single-part uploads). File size is
    bounded by ``MAX_RECORDS_PER_FILE``, so a whole-file read is bounded."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    rows = (reader.load(path).select("_metadata.file_path", "_metadata.file_size",
                                     "_metadata.file_modification_time")
            .groupBy("file_path", "file_size", "file_modification_time")
            .agg(F.count(F.lit(1)).cast("bigint").alias("rows")))
    pattern = "*.csv" if fmt == "csv" else f"*.{fmt}"
    tags = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(path)
            .select(F.col("path").alias("file_path"), F.md5("content").alias("content_md5"),
                    F.sha2("content", 256).alias("content_sha256")))
    return rows.join(tags, "file_path", "left").select(
        F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "file_path", "file_size",
        "file_modification_time", "rows", "content_md5", "content_sha256")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=None,
                  sort_within=None) -> str:
    w = df
    if sort_within:
        # Clusters each file by the sort keys without a shuffle, so min/max
        # statistics prune scans on those keys (the index replacement).
        w = w.sortWithinPartitions(*sort_within)
    writer = w.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


MANIFEST_SCHEMA = "sequence long, version string, digest string, file string, size long, sha256 string"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of the Parquet files of a folder, from their bytes (a file holds MAX_RECORDS_PER_FILE rows at most)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"),
                    F.sha2("content", 256).alias("sha256")))


def tree_digest(files: DataFrame) -> str:
    """One SHA-256 over (file, size, sha256): files are digested in 256 groups by name, in order, and the groups in order."""
    line = F.concat_ws(" ", "file", F.col("size").cast("string"), "sha256")
    groups = files.groupBy(F.substring(F.sha2("file", 256), 1, 2).alias("g")).agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("d"))
    return groups.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(" ", "g", "d")))), 256)).first()[0]


def _manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Committed manifest rows with the uri that they belong to; none if there is none."""
    try:
        found = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{pattern}/_manifest/*")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{MANIFEST_SCHEMA}, uri string")
    return found.select("*", F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/_manifest/", 1).alias("uri"))


def _live(spark: SparkSession, pattern: str) -> DataFrame:
    """(uri, version, sequence, digest) of the manifest that counts at each uri: the last one that was committed."""
    last = F.max(F.struct("sequence", "version", "digest")).alias("m")
    return _manifests(spark, pattern).groupBy("uri").agg(last).select("uri", "m.*")


def write_snapshot(pred: DataFrame, uri: str) -> str:
    """Write one batch to its own location ``uri``. A batch is one key: the
    same batch written again replaces itself and never doubles its rows.

    The rows go to a new folder below ``uri``; the manifest that names the
    folder and the SHA-256 of its files is one small file, written last. Until
    it is there, readers see the batch as it was, so a write that is lost
    halfway leaves the old rows in place.
    """
    spark = pred.sparkSession
    version = uuid.uuid4().hex
    before = _live(spark, uri).agg(F.max("sequence")).first()[0] or 0
    data = write_parquet(pred, f"{uri}/v-{version}")
    found = file_digests(spark, data)
    digest = tree_digest(found)
    rows = found.select(F.lit(before + 1).cast("long").alias("sequence"), F.lit(version).alias("version"),
                        F.lit(digest).alias("digest"), "file", "size", "sha256")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{uri}/_manifest/m-{version}")
    return uri


def snapshot_digest(spark: SparkSession, uri: str) -> str:
    """The SHA-256 that was stored with the batch at ``uri``."""
    row = _live(spark, uri).first()
    if row is None:
        raise FileNotFoundError(f"no committed batch at {uri}")
    return row["digest"]


def read_batch(spark: SparkSession, uri: str) -> DataFrame:
    """The rows of the batch at ``uri`` as its manifest names them."""
    row = _live(spark, uri).first()
    if row is None:
        raise FileNotFoundError(f"no committed batch at {uri}")
    return spark.read.parquet(f"{uri}/v-{row['version']}")


def changed_files(spark: SparkSession, uri: str) -> DataFrame:
    """(file, problem) of the batch at ``uri``: files whose bytes differ from the manifest's, are missing or are extra."""
    row = _live(spark, uri).first()
    if row is None:
        raise FileNotFoundError(f"no committed batch at {uri}")
    kept = _manifests(spark, uri).where(F.col("version") == row["version"]).select(
        "file", F.col("size").alias("old_size"), F.col("sha256").alias("old"))
    problem = (F.when(F.col("sha256").isNull(), "missing").when(F.col("old").isNull(), "extra")
               .when((F.col("sha256") != F.col("old")) | (F.col("size") != F.col("old_size")), "changed"))
    return kept.join(file_digests(spark, f"{uri}/v-{row['version']}"), "file", "full").select(
        "file", problem.alias("problem")).where("problem is not null")


def refuse_changed_files(spark: SparkSession, uri: str) -> None:
    """Raise ValueError naming the files of a batch that are no longer what was written."""
    bad = changed_files(spark, uri).orderBy("file").limit(20).collect()
    if bad:
        raise ValueError(f"the batch at {uri} was changed: {[(r['file'], r['problem']) for r in bad]}")


def read_snapshot(spark: SparkSession, root: str, scored_date: str | None = None) -> DataFrame:
    """All batches below ``root`` as their manifests name them: partition
    discovery + pruning on ``scored_date`` (the folder above a batch's own)."""
    paths = [f"{r['uri']}/v-{r['version']}" for r in _live(spark, f"{root}/scored_date=*/*").collect()]  # one per batch
    if not paths:
        raise FileNotFoundError(f"no committed batch below {root}")
    df = spark.read.option("basePath", root).parquet(*paths)
    if scored_date is not None:
        df = df.filter(F.col("scored_date") == F.lit(scored_date).cast("date"))
    return df


def dataset_fingerprint(df: DataFrame, columns: list | None = None) -> DataFrame:
    """Order-free content fingerprint (rows, hash_sum): the sum of the first
    32 bits of the MD5 of every row's text. ``columns`` may be expressions."""
    cols = columns or df.columns
    text = F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N"))
                              for c in cols])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                  F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string").alias("hash_sum"))
