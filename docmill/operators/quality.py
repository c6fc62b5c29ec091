"""Figures on an index: sizes, short chunks, files in focus, a conclusion. Parents have file_path, parent_id, content, heading_path; children parent_id, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmill.functions.text import blank_to_null

#: Lengths below which a chunk is short, share of short children and least number of split parents that are judged.
SHORT_PARENT, SHORT_CHILD, VERY_SHORT_CHILD, SHORT_SHARE = 120, 80, 50, 0.3


def one_row(*parts: DataFrame) -> DataFrame:
    """Aggregates of one row each as one row: their union, then the value of each column that isn't null. No join is needed."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def kb_stats(files: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row: files, parents, children."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one_row(one(files, "files"), one(parents, "parents"), one(children, "children"))


def manifest_files(files: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """(path, mtime, size, parent_ids, child_count): what the manifest says of each file; files without chunks have none."""
    n = children.groupBy("parent_id").agg(F.count("*").alias("n"))
    per = parents.select("file_path", "parent_id").distinct().join(n, "parent_id", "left").groupBy("file_path").agg(F.sort_array(F.collect_list("parent_id")).alias("parent_ids"), F.sum(F.coalesce("n", F.lit(0))).alias("child_count"))
    joined = files.join(per.withColumnRenamed("file_path", "path"), "path", "left")
    return joined.select("path", "mtime", "size", F.coalesce("parent_ids", F.array().cast("array<string>")).alias("parent_ids"), F.coalesce("child_count", F.lit(0)).alias("child_count"))


def chunk_quality(parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row: mean lengths, short chunks, parents with several children and parents without heading; 0 for empty tables."""
    p = parents.agg(F.count("*").alias("parents"), F.coalesce(F.avg(F.length("content")), F.lit(0.0)).alias("parent_mean"), F.count_if(F.length("content") < SHORT_PARENT).alias("short_parents"), F.count_if(blank_to_null("heading_path").isNull()).alias("no_heading"))
    c = children.agg(F.count("*").alias("children"), F.coalesce(F.avg(F.length("content")), F.lit(0.0)).alias("child_mean"), F.count_if(F.length("content") < SHORT_CHILD).alias("short_children"), F.count_if(F.length("content") < VERY_SHORT_CHILD).alias("very_short_children"))
    m = children.groupBy("parent_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split_parents"))
    return one_row(p, c, m)


def conclusion(quality: DataFrame) -> DataFrame:
    """The row of chunk_quality with a verdict: hardly split, many short children, or fine."""
    few = F.col("split_parents") < F.greatest(F.lit(2), F.floor(F.col("parents") / 10))
    many = F.col("short_children") > F.col("children") * SHORT_SHARE
    return quality.withColumn("verdict", F.when(few, "few_split").when(many, "many_short").otherwise("fine"))


def file_counts(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(file_path, parents, children): chunks of each file."""
    n = children.groupBy("parent_id").agg(F.count("*").alias("n"))
    return parents.select("file_path", "parent_id").join(n, "parent_id", "left").groupBy("file_path").agg(F.count("*").alias("parents"), F.sum(F.coalesce("n", F.lit(0))).alias("children"))


def focus_files(parents: DataFrame, children: DataFrame, most: int = 8) -> DataFrame:
    """The files with the highest 10 * parents + children; of equal scores the name that sorts last."""
    return file_counts(parents, children).withColumn("score", 10 * F.col("parents") + F.col("children")).orderBy(F.desc("score"), F.desc("file_path")).limit(most)
