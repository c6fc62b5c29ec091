"""Server-sent events and manifests as tables, in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MANIFEST = "kb_name string, root string, embedding_model string, embedding_dimension int, embedder_signature string, skipped array<struct<path: string, reason: string>>, files map<string, struct<mtime: double, size: bigint, parent_ids: array<string>, child_count: bigint>>, stats map<string, bigint>"


def frame(payload: Column) -> Column:
    """A JSON payload as one frame."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def parse_frames(streams: DataFrame, text: str, schema: str, *keys: str) -> DataFrame:
    """(keys..., pos, the schema's columns): the events of a stream's text; frames without data and bad JSON are skipped."""
    frames = streams.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n")).alias("pos", "frame"))
    lines = F.filter(F.split("frame", "\n"), lambda x: x.startswith("data:"))
    data = F.array_join(F.transform(lines, lambda x: F.ltrim(F.substring(x, 6, 1 << 30))), "\n")
    good = F.try_parse_json(data).isNotNull() & data.startswith("{")
    return frames.select(*keys, "pos", data.alias("data"), good.alias("good")).where(F.coalesce("good", F.lit(False))).select(*keys, "pos", F.from_json("data", schema).alias("e")).select(*keys, "pos", "e.*")


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """A manifest that is one JSON document, as one row with all its parts; no rows where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, size, parent_ids, child_count): the files of such a manifest."""
    return read_manifest_document(spark, path).select(F.explode("files").alias("path", "f")).select("path", "f.*")


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason): the files that such a manifest says were left out."""
    return read_manifest_document(spark, path).select(F.inline("skipped"))
