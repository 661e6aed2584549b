"""Queries of the text-corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import mixing, names, neardup, packing, pieces, stuffing, tokens
from halyard.session import materialize
from halyard.sources.tables import table


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reports", "report_id", "text", "split", "source")


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.name_entities(table(spark, folder, "raw_reports", "ORGAN_NAME", "AUTHOR_NAME"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(_entities(spark, folder))


def p1_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(spark, folder)


def p1_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with the number of entities it stands for."""
    return _entities(spark, folder).groupBy("field", "name").agg(F.count_distinct("entity").alias("entities"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.split_overlaps(_reports(spark, folder)).select("report_id_a", "report_id_b").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.overlap_report(_reports(spark, folder))


def p2_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The overlaps of equal canonical records alone."""
    return neardup.split_overlaps(_reports(spark, folder)).where("exact").select("eval_id", "train_id").distinct()


def _titled(spark: SparkSession, folder: str) -> tuple[DataFrame, str, Column]:
    raw = table(spark, folder, "raw_reports", "ID", "TITLE", "CONTENT").where("CONTENT is not null")
    return raw, "ID", F.concat(F.coalesce("TITLE", F.lit("")), "CONTENT")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_pairs(*_titled(spark, folder)).select("id_a", "id_b")


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(*_titled(spark, folder))


def p7_links(spark: SparkSession, folder: str) -> DataFrame:
    """Similar pairs of different texts, each text by the least ID that has it; ``p7_classes`` says which IDs these are."""
    return neardup.near_duplicate_links(*_titled(spark, folder))[1]


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_links(*_titled(spark, folder))[0]


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Reports whose canonical text others have too, with the number of reports that have it."""
    return neardup.near_duplicate_groups(*_titled(spark, folder)).where("n_copies > 1").select("ident", "n_copies")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_texts(table(spark, folder, "reports", "report_id", "text"), "report_id", "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reports that came out in several pieces."""
    return _pieces(spark, folder).where("piece_no = 1").select(F.col("ident").alias("report_id")).distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).withColumnRenamed("ident", "report_id")


def p3_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Per report what its pieces say of it: length, hash of the text put together again, the longest piece, and the least and largest overlap
    within bounds (1) or not (0)."""
    p = _pieces(spark, folder)
    parts = p.groupBy("ident").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"))  # the pieces of one text
    fresh = F.transform("p", lambda x, i: F.substring(x["piece"], F.when(i == 0, F.lit(1)).otherwise(F.get(F.col("p.end"), i - 1) - x["start"] + 1).cast("int"), F.lit(pieces.LIMIT)))
    over = F.transform(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda x, i: F.get(F.col("p.end"), i) - x["start"])
    low, high = pieces.OVERLAP // 2, pieces.OVERLAP + pieces.OVERLAP // 2
    return parts.select(
        F.col("ident").alias("report_id"), F.array_max("p.end").alias("n_chars"), F.md5(F.array_join(fresh, "")).alias("digest"),
        F.forall("p", lambda x: F.length(x["piece"]) <= pieces.LIMIT).cast("int").alias("within_limit"), F.forall(over, lambda x: x.between(low, high)).cast("int").alias("overlaps"),
    )


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return packing.pack_texts(docs, table(spark, folder, "pack_specs"), lambda d: tokens.token_counts(d, "doc_id", "text"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, folder))


def p8_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec: documents placed, containers above their capacity, documents cut without need, and documents whose pieces leave gaps."""
    rows = materialize(p8_packed(spark, folder), "packed")
    full = rows.groupBy("spec_name", "container_id").agg((F.sum("tokens") > F.max("capacity")).alias("bad")).groupBy("spec_name").agg(F.count_if("bad").alias("overfull"))
    largest = rows.groupBy("spec_name").agg(F.max("capacity").alias("largest"))
    docs = rows.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("t"), F.max(F.col("token_from") + F.col("tokens")).alias("to"), F.count(F.lit(1)).alias("k")).join(largest, "spec_name")
    found = docs.groupBy("spec_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("k") > 1) & (F.col("t") <= F.col("largest"))).alias("cut_without_need"), F.count_if(F.col("t") != F.col("to")).alias("gaps"))
    return found.join(full, "spec_name").where("spec_name <> 'joint'").select("spec_name", "documents", "overfull", "cut_without_need", "gaps")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    sized = materialize(tokens.token_counts(docs, "doc_id", "text", "source"), "sizes")
    return mixing.mix(sized, table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.share_report(p9_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p9_targets_met(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: whether its share of tokens is within half a percent of the target, and no document used more often than permitted."""
    got = p9_shares(spark, folder)
    return got.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005).cast("int").alias("share_met"), (F.col("repeats") <= F.col("max_repeats")).cast("int").alias("repeats_met"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.line_shares(table(spark, folder, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.flagged(_lines(spark, folder)).select("doc_id")


def p10_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder)


def p10_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of every document, and whether its shares by state add up to all of them."""
    return _lines(spark, folder).select("doc_id", "n_chars", (F.abs(sum(F.col(s) for s in stuffing.STATES) - F.when(F.col("n_chars") > 0, 1).otherwise(0)) < 1e-9).cast("int").alias("whole"))


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p1_spellings": p1_spellings,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_exact": p2_exact,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_rebuilt": p3_rebuilt,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p7_copies": p7_copies,
    "p7_links": p7_links,
    "p7_classes": p7_classes,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p8_placed": p8_placed,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_targets_met": p9_targets_met,
    "p10_found": p10_found,
    "p10_lines": p10_lines,
    "p10_sizes": p10_sizes,
}

_CANON = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"
ORACLE: dict[str, str] = {
    "p1_spellings": """SELECT DISTINCT 'ORGAN_NAME' AS field, ORGAN_NAME AS name, 1 AS entities FROM raw_reports WHERE trim(replace(ORGAN_NAME, '　', ' ')) <> ''
UNION SELECT DISTINCT 'AUTHOR_NAME', name, 1 FROM (SELECT regexp_replace(unnest(regexp_split_to_array(AUTHOR_NAME, '[,，、;]')), '^[\\s　]+|[\\s　]+$', '', 'g') AS name FROM raw_reports) WHERE name <> ''""",
    "p2_exact": f"""WITH c AS (SELECT DISTINCT report_id, split, {_CANON.format('text')} AS k FROM reports WHERE split IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT e.report_id AS eval_id, t.report_id AS train_id FROM c e JOIN c t USING (k) WHERE length(k) >= 5 AND e.split IN ('validation', 'test') AND t.split = 'train' AND e.report_id <> t.report_id""",
    "p3_found": "SELECT report_id FROM reports WHERE length(text) > 1200 GROUP BY report_id",
    "p3_rebuilt": "SELECT report_id, length(text) AS n_chars, md5(text) AS digest, 1 AS within_limit, 1 AS overlaps FROM reports WHERE text IS NOT NULL",
    "p7_copies": f"""WITH c AS (SELECT DISTINCT ID AS ident, {_CANON.format("coalesce(TITLE, '') || CONTENT")} AS k FROM raw_reports WHERE CONTENT IS NOT NULL AND ID IS NOT NULL)
SELECT * FROM (SELECT ident, count(*) OVER (PARTITION BY k) AS n_copies FROM c WHERE length(k) >= 5) WHERE n_copies > 1""",
    "p7_classes": f"""WITH c AS (SELECT DISTINCT ID AS ident, {_CANON.format("coalesce(TITLE, '') || CONTENT")} AS k FROM raw_reports WHERE CONTENT IS NOT NULL AND ID IS NOT NULL)
SELECT DISTINCT ident, min(ident) OVER (PARTITION BY k) AS class_id FROM c WHERE length(k) >= 5""",
    "p8_placed": "SELECT spec_name, (SELECT count(*) FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) AS documents, 0 AS overfull, 0 AS cut_without_need, 0 AS gaps FROM pack_specs",
    "p9_targets_met": "SELECT source, 1 AS share_met, 1 AS repeats_met FROM mix_targets",
    "p10_sizes": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, 1 AS whole FROM documents",
}
