"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm import encoding, knn, lookalike, markup, mixing, splitting, subjects, tokens
from docmill.session import spread, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "parent_docs").select(F.lit("parent_docs").alias("tbl"), F.col("parent_id").alias("rec_id"), F.col("content").alias("text"))
    previews = table(spark, d, "file_previews").select(F.lit("file_previews").alias("tbl"), F.col("preview_id").alias("rec_id"), F.col("preview_text").alias("text"))
    return spread(parents.unionByName(previews))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(_records(spark, d), ["tbl", "rec_id"])


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(_records(spark, d), ["tbl", "rec_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    unified = lookalike.unify(_records(spark, d), ["tbl", "rec_id"], "text", with_text=False)
    return lookalike.same_look_pairs(unified, "tbl", "rec_id")


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify(_records(spark, d), ["tbl", "rec_id"], "text").select("tbl", "rec_id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stripped = markup.strip_markup(spread(table(spark, d, "parent_docs").select("parent_id", "content")), ["parent_id"], "content")
    return stripped.where(F.col("marks") > 0).select("parent_id").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.strip_markup(spread(table(spark, d, "parent_docs").select("parent_id", "content")), ["parent_id"], "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embed_vectors").select("vec_id", "vectors", "is_probe")
    return knn.neighbor_pairs(knn.nearest(vectors, k=5, dim=64, query=F.col("is_probe")))


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embed_vectors").select("vec_id", "vectors")
    found = knn.nearest(vectors, k=5, dim=64, query=F.col("vec_id") % 20 == 0)
    return found.select(F.col("query_id").alias("vec_id"), "rank", "neighbor_id", F.round("similarity", 6).alias("similarity"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "parent_docs").select(F.lit("parent_docs").alias("tbl"), F.col("parent_id").alias("item_id"), F.col("content").alias("text"))
    sections = table(spark, d, "pdf_sections").select(F.lit("pdf_sections").alias("tbl"), F.col("section_id").cast("string").alias("item_id"), splitting.joined("body_texts").alias("text"))
    drafts = table(spark, d, "pdf_drafts").select(F.lit("pdf_drafts").alias("tbl"), F.col("draft_id").cast("string").alias("item_id"), splitting.joined("texts").alias("text"))
    return spread(parents.unionByName(sections).unionByName(drafts))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_items(spark, d), ["tbl", "item_id"], "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(_items(spark, d), ["tbl", "item_id"], "text", with_text=False)
    return pieces.where(F.col("piece_no") == 1).select("tbl", "item_id").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "file_path", "source", "doc_type"))
    model = subjects.fit_subjects(docs, table(spark, d, "subject_seeds"), table(spark, d, "subject_areas"))
    return subjects.subjects_of(docs, model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects(spark, d).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and signs of text on each subject."""
    held = p9_subjects(spark, d).join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return held.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("share") * F.col("n"))).cast("long").alias("signs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_text, p3_found, p3_clean, p5_found, p5_neighbors, p6_found, p6_pieces, p7_ids, p8_mix, p8_shares, p9_found, p9_subjects, p9_composition)}


_PROPER = """select vec_id, is_probe, cast(vectors as double[]) as v from embed_vectors
 where len(vectors) = 64 and len(list_filter(vectors, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vectors, lambda x: x <> 0)) > 0"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"""with ok as ({_PROPER}), r as (select a.vec_id q, b.vec_id n, row_number() over (partition by a.vec_id order by
 list_cosine_similarity(a.v, b.v) desc, b.vec_id) k from ok a join ok b on a.vec_id <> b.vec_id where a.is_probe)
 select distinct least(q, n) vec_a, greatest(q, n) vec_b from r where k <= 5""",
        "p5_neighbors": f"""with ok as ({_PROPER}), r as (select a.vec_id, b.vec_id neighbor_id, list_cosine_similarity(a.v, b.v) s, row_number() over (partition by a.vec_id order by
 list_cosine_similarity(a.v, b.v) desc, b.vec_id) k from ok a join ok b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select vec_id, cast(k as int) as rank, neighbor_id, round(s, 6) as similarity from r where k <= 5""",
        "p6_found": """select 'parent_docs' tbl, parent_id item_id from parent_docs where length(content) > 2000
 union select 'pdf_sections', cast(section_id as varchar) from pdf_sections where length(array_to_string(list_filter(body_texts, lambda x: x is not null and x <> ''), chr(10) || chr(10))) > 2000
 union select 'pdf_drafts', cast(draft_id as varchar) from pdf_drafts where length(array_to_string(list_filter(texts, lambda x: x is not null and x <> ''), chr(10) || chr(10))) > 2000""",
    }
