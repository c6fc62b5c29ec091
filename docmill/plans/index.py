"""Building a knowledge-base index: scan, load, clean, cut, embed, store; from scratch or for changed files only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.functions.text import embedding_text
from docmill.operators import catalog, chunking, cleaning, embedding, quality, retrieval, structure
from docmill.operators.incremental import VersionedTarget
from docmill.session import cut_lineage
from docmill.sources import files as source, pdf, sinks


@dataclass(frozen=True)
class KnowledgeBase:
    """What is indexed and how."""

    name: str
    root: str
    include_ext: tuple[str, ...] = catalog.INCLUDE_EXT
    exclude_glob: tuple[str, ...] = catalog.EXCLUDE_GLOB
    max_mb: int = 50


MANIFEST = "path string, mtime double, size bigint"
#: What is said of a PDF without text: it was read and has nothing to index.
NO_TEXT = "no text"


def load(spark: SparkSession, kb: KnowledgeBase, paths: DataFrame, work: str, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): the cleaned documents of some files, and (path, reason) of those that can't be read.

    Files are read and parsed once: what is loaded goes to `work` first. PDF documents come from their text blocks, read here
    or given.
    """
    listed = source.binary_files(spark, kb.root).join(paths.select("path"), "path", "left_semi")
    source.load_documents(listed.where(catalog.suffix_of("path") != ".pdf")).write.parquet(f"{work}/loaded")
    loaded = spark.read.parquet(f"{work}/loaded")
    if blocks is None:
        pdf.blocks(listed.where(catalog.suffix_of("path") == ".pdf")).write.parquet(f"{work}/blocks")
        blocks = spark.read.parquet(f"{work}/blocks")
    elif "error" not in blocks.columns:
        blocks = blocks.withColumn("error", F.lit(None).cast("string"))
    blocks = blocks.join(paths.select(F.col("path").alias("file")), "file", "left_semi")
    errors = loaded.where(F.col("error").isNotNull()).select(F.col("file_path").alias("path"), "error")
    errors = errors.unionByName(blocks.where(F.col("error").isNotNull() & (F.col("error") != NO_TEXT)).select(F.col("file").alias("path"), "error"))
    paged = structure.paged_documents(blocks.where(F.col("error").isNull()).drop("error"))
    modified = source.catalogue(spark, kb.root).select(F.col("path").alias("file"), "mtime")
    paged = paged.join(modified, "file").select(F.col("file").alias("file_path"), F.lit("pdf").alias("doc_type"), F.col("draft_no").cast("long").alias("doc_no"), "text", "page_number", "page_end", "heading_path", "section_title", "mtime")
    loaded = loaded.where(F.col("error").isNull() & F.col("text").isNotNull()).drop("error").unionByName(paged, allowMissingColumns=True)
    return cleaning.enhance(loaded, kb.name), errors.select("path", F.concat(F.lit("load_failed: "), "error").alias("reason")).distinct()


def current(spark: SparkSession, out: str) -> str:
    """The folder of the newest published version of an index."""
    target = VersionedTarget(spark, out)
    numbers = target.versions()
    if not numbers:
        raise FileNotFoundError(f"no index at {out}")
    return target.folder(numbers[-1])


def build(spark: SparkSession, kb: KnowledgeBase, out: str, encoder: Callable[[], Callable] | None = None, dimension: int = 64, incremental: bool = False, blocks: DataFrame | None = None) -> dict:
    """Builds the index at `out` as a new version; returns its counts.

    A version is a folder with parents, parent_docs, child_chunks, manifest and skipped; it is read only once it is published
    as a whole, so a run that dies leaves the version before as it is. incremental=True takes the chunks of unchanged files
    over from that version and leaves out deleted ones; it fails if the version was built with another encoder, and builds all
    if there is none. Files that can't be read are told in skipped, are no part of the manifest and so are tried again.
    Children are embedded with the headings that they stand under and keep the metadata of their parents.
    """
    make = encoder or (lambda: embedding.HashingEncoder(dimension))
    made = make()
    model = getattr(made, "model", type(made).__name__)
    sign = embedding.signature(getattr(made, "provider", "custom"), model, dimension)
    target = VersionedTarget(spark, out)
    numbers = target.versions() if incremental else []
    before = target.folder(numbers[-1]) if numbers else None
    if before:
        head = json.loads(target._commit(numbers[-1])["head"])
        if head["embedder_signature"] != sign:
            raise ValueError(f"the index was built with {head['embedder_signature']}, not {sign}")
    listing = source.catalogue(spark, kb.root)
    manifest = spark.read.schema(MANIFEST).json(f"{before}/manifest") if before else spark.createDataFrame([], MANIFEST)
    scanned = cut_lineage(catalog.scan(listing, manifest, kb.max_mb, kb.include_ext, kb.exclude_glob))
    changed = scanned.where(F.col("status").isin("added", "modified")).select("path")
    kept = scanned.where(F.col("status") == "unchanged").select("path")
    n = (target.versions() or [0])[-1] + 1
    folder = f"v={n}-{uuid.uuid4().hex[:12]}"
    made_in = f"{target.root}/{folder}"
    work = f"{made_in}/work"
    docs, errors = load(spark, kb, changed, work, blocks)
    chunking.split_parents(docs).write.parquet(f"{work}/parents")
    parents = spark.read.parquet(f"{work}/parents")
    children = chunking.split_children(parents, make).withColumn("_text", embedding_text("content", "doc_type", "heading_path"))
    children = embedding.embed(children, "_text", make).drop("_text").withColumn("embedding", embedding.checked("embedding", dimension))
    children.write.parquet(f"{work}/children")
    children = spark.read.parquet(f"{work}/children")
    if before:
        old = spark.read.parquet(f"{before}/parents").join(kept.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        old_children = spark.read.parquet(f"{before}/child_chunks").join(kept.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        parents, children = parents.unionByName(old), children.unionByName(old_children)
    parents.write.parquet(f"{made_in}/parents")
    parents = spark.read.parquet(f"{made_in}/parents")
    sinks.write_parents(parents, made_in)
    sinks.write_children(children, made_in)
    children = spark.read.parquet(f"{made_in}/child_chunks")
    files = listing.join(kept.unionByName(changed), "path", "left_semi").join(errors.select("path"), "path", "left_anti")
    skipped = scanned.where(F.col("status") == "skipped").select("path", "reason").unionByName(errors)
    stats = quality.kb_stats(files, parents, children).first().asDict()
    head = sinks.manifest_head(kb.name, kb.root, model, dimension, sign, stats)
    sinks.write_manifest(quality.manifest_files(files, parents, children), skipped, made_in, head)
    target.drop(f"{folder}/work")
    try:
        target.publish(n, folder, head=json.dumps(head, ensure_ascii=False))
    except FileExistsError:
        target.drop(folder)
        raise
    return stats


def query(spark: SparkSession, out: str, texts: list[str], k: int = 5, encoder: Callable[[], Callable] | None = None, dimension: int = 64) -> DataFrame:
    """The k best children of each query text with their parents."""
    encode = (encoder or (lambda: embedding.HashingEncoder(dimension)))()
    if not texts or any(not t.strip() for t in texts):
        raise ValueError("a query must not be blank")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(encode(texts))]
    queries = spark.createDataFrame(rows, "query_id int, query_vector array<float>")
    folder = current(spark, out)
    children = spark.read.parquet(f"{folder}/child_chunks")
    return retrieval.with_parents(retrieval.top_k(children, queries, k), children, spark.read.parquet(f"{folder}/parents"))
