"""Stores of an index: parents, children, manifest, dumps and reports. Tables are replaced as a whole; the manifest comes last."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmill.functions.text import preview


def sanitized(metadata: Column) -> Column:
    """A map of texts without null and empty entries; "0" and "false" stay."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != ""))


def write_parents(parents: DataFrame, root: str) -> None:
    """parent_id, content, metadata_json, one row for each parent_id; replaces the store."""
    rest = [c for c in parents.columns if c not in ("parent_id", "content")]
    rows = parents.where(F.col("parent_id").isNotNull() & F.col("content").isNotNull()).dropDuplicates(["parent_id"])
    rows.select("parent_id", "content", F.to_json(F.struct(*rest)).alias("metadata_json")).write.mode("overwrite").parquet(f"{root}/parent_docs")


def write_children(children: DataFrame, root: str) -> None:
    """Children with their vectors; replaces the store, an empty table too."""
    children.write.mode("overwrite").parquet(f"{root}/child_chunks")


def get_parents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """wanted (parent_id) with content and metadata_json, null where a parent is unknown."""
    return wanted.join(spark.read.parquet(f"{root}/parent_docs"), "parent_id", "left")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small UTF-8 file, replaced by renaming."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, made = hadoop.Path(path), hadoop.Path(path + ".tmp")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(made, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(final, False)
    if not fs.rename(made, final):
        raise OSError(f"cannot write {path}")


def manifest_head(kb_name: str, source_root: str, model: str, dimension: int, signature: str, stats: dict[str, int]) -> dict:
    """What a manifest says of the index as a whole."""
    made = datetime.now(timezone.utc).isoformat(timespec="seconds")
    return {"kb_name": kb_name, "root": source_root, "embedding_model": model, "embedding_dimension": dimension, "embedder_signature": signature, "stats": stats, "built_at": made}


def write_manifest(files: DataFrame, skipped: DataFrame, root: str, head: dict) -> None:
    """One JSON document a file in manifest/ and a skipped file in skipped/ (path, reason), written by all tasks, and the head in manifest.json, written last by the driver."""
    files.select("path", "mtime", "size", "parent_ids", "child_count").write.mode("overwrite").json(f"{root}/manifest")
    skipped.select("path", "reason").write.mode("overwrite").json(f"{root}/skipped")
    write_text(files.sparkSession, f"{root}/manifest.json", json.dumps(head, ensure_ascii=False, indent=2))


def chunk_dump(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents and children with the columns of the dump and a preview of 300 signs."""
    p = parents.select(F.lit("parent").alias("chunk_level"), "file_path", "doc_type", "parent_id", F.lit(None).cast("string").alias("child_id"), "heading_path", F.length("content").alias("char_count"), preview("content", 300).alias("preview"))
    c = children.join(parents.select("parent_id", "file_path", "doc_type", "heading_path"), "parent_id").select(F.lit("child").alias("chunk_level"), "file_path", "doc_type", "parent_id", "child_id", "heading_path", F.length("content").alias("char_count"), preview("content", 300).alias("preview"))
    return p.unionByName(c)


def write_chunk_dump(parents: DataFrame, children: DataFrame, path: str) -> None:
    chunk_dump(parents, children).write.mode("overwrite").json(path)


def report_lines(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(file_path, line_no, line): a Markdown report of each file's parents and children; one file is put together in one task."""
    from docmill.functions.text import escape_table

    rows = chunk_dump(parents, children).withColumn("order", F.struct("parent_id", F.when(F.col("chunk_level") == "parent", 0).otherwise(1), F.coalesce("child_id", F.lit(""))))
    text = F.when(F.col("chunk_level") == "parent", F.concat(F.lit("## "), F.coalesce("heading_path", F.lit("")), F.lit(" ("), F.col("char_count").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("- "), escape_table("preview")))
    lines = rows.groupBy("file_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("order", text.alias("t")))), lambda x: x["t"]).alias("lines"))
    return lines.select("file_path", F.posexplode(F.concat(F.array(F.concat(F.lit("# "), "file_path")), "lines")).alias("line_no", "line"))


def query_section(hits: DataFrame) -> DataFrame:
    """(query_id, line_no, line): the part of a report on queries: rank, score and preview of the rows of retrieval.query_report, in order; a query without hits says so."""
    from docmill.functions.text import escape_table

    line = F.concat(F.lit("- "), F.col("rank").cast("string"), F.lit(". ("), F.format_number("score", 4), F.lit(") "), escape_table(F.coalesce("preview", F.lit(""))))
    held = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", line.alias("t"))))), lambda x: x["t"]).alias("lines"))
    body = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array(F.lit("- no hits")))
    return held.select("query_id", F.posexplode(F.concat(F.array(F.concat(F.lit("## query "), F.col("query_id").cast("string"))), body)).alias("line_no", "line"))


#: What each verdict of quality.conclusion advises.
ADVICE = {"few_split": "Hardly any parent is split: look at the cut of children.", "many_short": "Many children are short: look at how short ones are joined.", "fine": "Parents and children are well cut."}


def evaluation_report(spark: SparkSession, quality: DataFrame, focus: DataFrame, path: str, hits: DataFrame | None = None) -> str:
    """Writes the figures of one index as Markdown: key figures, conclusion, files in focus and hits of queries; returns the text.

    quality is the one row of quality.chunk_quality, focus a handful of files, hits the rows of retrieval.query_report for the
    few queries of a report.
    """
    from docmill.operators.quality import conclusion

    row = conclusion(quality).first().asDict()
    share = lambda n, of: f"{row[n]} ({100 * row[n] / row[of]:.1f} %)" if row[of] else f"{row[n]}"
    lines = [
        "# Evaluation of the index", "", "## Key figures", "", "| figure | value |", "| --- | --- |", f"| parents | {row['parents']} |", f"| children | {row['children']} |",
        f"| children a parent | {row['children'] / row['parents'] if row['parents'] else 0:.2f} |", f"| mean length of parents | {row['parent_mean']:.1f} |", f"| mean length of children | {row['child_mean']:.1f} |",
        f"| short parents | {share('short_parents', 'parents')} |", f"| short children | {share('short_children', 'children')} |", f"| very short children | {share('very_short_children', 'children')} |",
        f"| split parents | {share('split_parents', 'parents')} |", f"| parents without heading | {share('no_heading', 'parents')} |", "", "## Conclusion", "", ADVICE[row["verdict"]], "", "## Files in focus", "", "| file | parents | children |", "| --- | --- | --- |",
    ]
    lines += [f"| {r['file_path']} | {r['parents']} | {r['children']} |" for r in focus.collect()]
    if hits is not None:
        lines += ["", *(r["line"] for r in query_section(hits).orderBy("query_id", "line_no").collect())]
    text = "\n".join(lines) + "\n"
    write_text(spark, path, text)
    return text
