"""Queries of the corpus problems, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.cooccurrence import associated_tags
from mnemolake.llm.leakage import leaked_runs, paraphrases
from mnemolake.llm.mojibake import repair_encoding
from mnemolake.llm.near_dup import near_duplicate_groups, near_duplicate_pairs
from mnemolake.llm.packing import INSTRUCTION, Limits, pack_documents, packing_report
from mnemolake.session import Scratch
from mnemolake.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, root, "records"))


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicate_groups(table(spark, root, "records"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return associated_tags(table(spark, root, "records")).select("tag_a", "tag_b")


def p3_scores(spark: SparkSession, root: str) -> DataFrame:
    scores = associated_tags(table(spark, root, "records"))
    return scores.select("tag_a", "tag_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"), F.round("jaccard", 6).alias("jaccard"))


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(table(spark, root, "documents"))


def p7_instruct(spark: SparkSession, root: str) -> DataFrame:
    """Under the limits of instruction data, all three of which bind."""
    return pack_documents(table(spark, root, "documents"), INSTRUCTION)


def _reports(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    one = lambda name, limits: packing_report(Scratch(spark, "placed").write(pack_documents(documents, limits), "placed"), limits).withColumn("limits", F.lit(name))
    return one("plain", Limits()).unionByName(one("instruct", INSTRUCTION))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the sequences are, how few there could be, and how many stand at a limit."""
    return _reports(spark, root).select("limits", "sequences", "least_sequences", "tokens", "fill", "most_segments", "full_segments", "full_loss")


def p7_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What packing promises, as numbers that SQL can name without packing."""
    return _reports(spark, root).select("limits", "texts", "empty_texts", "over_tokens", "over_segments", "over_loss", "split_texts", "broken_texts")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_runs(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_paraphrases(spark: SparkSession, root: str) -> DataFrame:
    return paraphrases(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return repair_encoding(table(spark, root, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, root: str) -> DataFrame:
    return repair_encoding(table(spark, root, "documents"))


def p9_routes(spark: SparkSession, root: str) -> DataFrame:
    """How many documents each way of p9_found finds."""
    return repair_encoding(table(spark, root, "documents")).groupBy("route").agg(F.count("*").alias("n"))


def p9_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Every item, damaged by reading its UTF-8 bytes as Latin-1 (twice, for every second one) and restored."""
    items = table(spark, root, "eval_items").select("item_id", F.col("item_text").alias("original"))
    once = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    damaged = items.withColumn("text", F.when(F.col("item_id") % 2 == 0, once(once(F.col("original")))).otherwise(once(F.col("original"))))
    fixed = repair_encoding(damaged, "item_id").select("item_id", "restored")
    return damaged.join(fixed, "item_id", "left").select("item_id", F.coalesce("restored", "text").alias("item_text"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_scores, p7_packed, p7_instruct, p7_fill, p7_invariants, p8_found, p8_paraphrases, p9_found, p9_restored, p9_routes, p9_roundtrip)}


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}_]+'), lambda x: strlen(x) > 1 OR regexp_full_match(x, '\p{{N}}+'))"


_P3 = """
WITH b AS (SELECT row_number() OVER () AS rid, list_distinct(list_filter(list_transform(coalesce(tags, []), lambda x: lower(trim(x, ' \t\r\n'))), lambda x: len(x) > 0)) AS t FROM records),
e AS (SELECT rid, unnest(t) AS tag FROM b), s AS (SELECT tag, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT count(*) AS total FROM b WHERE len(t) > 0),
p AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n_ab FROM e x JOIN e y ON x.rid = y.rid AND x.tag < y.tag GROUP BY ALL HAVING count(*) >= 10),
f AS (SELECT tag_a, tag_b, n_ab, u.n AS n_a, v.n AS n_b, CAST(n_ab AS DOUBLE) * total / (CAST(u.n AS DOUBLE) * v.n) AS lift FROM p JOIN s u ON u.tag = tag_a JOIN s v ON v.tag = tag_b, m)
"""


_P1 = rf"""
b AS (SELECT id, list_distinct({tokens_sql("coalesce(body, '')")}) AS bt, list_distinct({tokens_sql("array_to_string(list_concat([coalesce(body, '')], coalesce(tags, [])), ' ')")}) AS t FROM records),
s AS (SELECT translate(upper(id), 'OIL', '011') AS id, t, len(t) AS n FROM b WHERE len(bt) >= 8),
e AS (SELECT id, n, unnest(t) AS w FROM s),
c AS (SELECT x.id AS id_a, y.id AS id_b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM e x JOIN e y ON x.w = y.w AND x.id < y.id AND x.n >= 0.69 * y.n AND y.n >= 0.69 * x.n GROUP BY ALL),
f AS (SELECT id_a, id_b FROM c WHERE 10 * k >= 7 * (na + nb - k))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3 + "SELECT tag_a, tag_b FROM f WHERE lift >= 4",
        "p3_scores": _P3 + "SELECT tag_a, tag_b, n_ab, n_a, n_b, round(lift, 6) AS lift, round(log2(lift), 6) AS pmi, round(n_ab / (n_a + n_b - n_ab), 6) AS jaccard FROM f WHERE lift >= 4",
        "p7_invariants": "SELECT limits, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS texts, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND coalesce(text, '') = '') AS empty_texts, 0 AS over_tokens, 0 AS over_segments, 0 AS over_loss, 0 AS split_texts, 0 AS broken_texts FROM (VALUES ('plain'), ('instruct')) AS l(limits)",
        "p8_found": rf"""
WITH d AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {tokens_sql("item_text")} AS t FROM eval_items),
dg AS (SELECT doc_id, array_to_string(list_slice(t, k, k + 9), ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 8)) AS k FROM d WHERE len(t) >= 10)),
ig AS (SELECT item_id, array_to_string(list_slice(t, k, k + 9), ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 8)) AS k FROM i WHERE len(t) >= 10))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p9_roundtrip": "SELECT item_id, item_text FROM eval_items",
        "p1_found": f"WITH {_P1} SELECT id_a, id_b FROM f",
        "p1_groups": f"""WITH RECURSIVE {_P1}, l AS (SELECT id_a AS u, id_b AS v FROM f UNION ALL SELECT id_b, id_a FROM f),
g AS (SELECT id, id AS near FROM s UNION SELECT g.id, l.v FROM g JOIN l ON l.u = g.near), m AS (SELECT id, min(near) AS group_id, count(*) AS group_size FROM g GROUP BY id)
SELECT m.id, group_id, group_size, (SELECT count(*) FROM l WHERE l.u = m.id) AS n_links FROM m""",
    }
