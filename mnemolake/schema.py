"""The record: its columns, enumerations, and the rules a well-formed one keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions.ids import canonical, canonical_all

# Fixed values.
KINDS = ("episode", "fact", "procedure", "artifact_ref", "tombstone", "retraction", "conflict")
EVIDENCE_RANK = {"observed": 3, "asserted": 2, "derived": 1}
SUPERSEDING_KINDS = ("tombstone", "retraction")
CLAIM_KINDS = ("fact", "procedure")
UNINDEXED_KINDS = ("tombstone", "conflict")
POLICIES = {"agent": "lww", "user": "siblings-auto", "shared": "siblings-manual"}
OTHER_POLICY = "siblings-manual"
ZERO_ID = "0" * 26
MAX_BODY, MAX_TAGS, MAX_TAG, MAX_EDGES, MAX_CONTEXT, MAX_NAME, MAX_SPACE = 1 << 20, 64, 128, 256, 512, 128, 200
NODE = r"^[A-Za-z0-9._-]{1,128}$"
SPACE = r"^(agent|user|shared)/[A-Za-z0-9._-]+$"
AGENT_NAME = r"^[A-Za-z0-9._-]{1,64}$"

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("space", T.StringType()), T.StructField("author_node", T.StringType()), T.StructField("author_agent", T.StringType()),
        T.StructField("author_model", T.StringType()), T.StructField("hlc", T.StructType([T.StructField("wall", T.LongType()), T.StructField("counter", T.LongType())])), T.StructField("epoch", T.LongType()),
        T.StructField("kind", T.StringType()), T.StructField("body", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("supersedes", T.ArrayType(T.StringType())),
        T.StructField("refs", T.ArrayType(T.StringType())), T.StructField("causal_ctx", T.MapType(T.StringType(), T.StringType())), T.StructField("evidence", T.StringType()), T.StructField("embed_model", T.StringType()),
        T.StructField("sig", T.BinaryType()), T.StructField("bytes", T.LongType()), T.StructField("received_at", T.TimestampNTZType()),
    ]
)


def canonical_records(records: DataFrame) -> DataFrame:
    """Ids of records and edges in canonical form; edge arrays distinct and never null."""
    return records.withColumns({"id": canonical("id"), "supersedes": canonical_all("supersedes"), "refs": canonical_all("refs")})


def normalized(c: Column | str) -> Column:
    """A repeated field sorted and without repeats; empty becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    tidy = F.array_sort(F.array_distinct(c))
    return F.when(F.size(c) > 0, tidy)


def space_class(c: Column | str) -> Column:
    return F.split_part(F.col(c) if isinstance(c, str) else c, F.lit("/"), F.lit(1))


def policy(c: Column | str) -> Column:
    kind = space_class(c)
    out = F.lit(OTHER_POLICY)
    for name, label in POLICIES.items():
        out = F.when((kind == name) & F.contains(F.col(c) if isinstance(c, str) else c, F.lit("/")), label).otherwise(out)
    return out


def auto_resolves(c: Column | str) -> Column:
    """Whether the space's policy resolves contradictions by itself."""
    return policy(c) != OTHER_POLICY


def keeps_siblings(c: Column | str) -> Column:
    """Whether contradicting records of the space stay side by side."""
    return policy(c) != POLICIES["agent"]


def evidence_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(0)
    for name, rank in EVIDENCE_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def agent_or_default(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "default").otherwise(c)


def agent_name_valid(c: Column) -> Column:
    return c.rlike(AGENT_NAME) & ~c.isin(".", "..")


def _bytes(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0))


def first_violation(records: DataFrame) -> Column:
    """The first rule a record breaks, in the order they are checked, or null."""
    col = F.col
    size = lambda c: F.greatest(F.size(F.coalesce(col(c), F.array().cast("array<string>"))), F.lit(0))
    each = lambda c, f: F.exists(F.coalesce(col(c), F.array().cast("array<string>")), f)
    tags = F.coalesce(col("tags"), F.array().cast("array<string>"))
    edges = lambda c: F.when(size(c) > MAX_EDGES, f"too many {c}").when(each(c, lambda x: canonical(x) == ZERO_ID), f"zero id in {c}").when(each(c, lambda x: canonical(x) == canonical("id")), f"self in {c}")
    context = F.coalesce(col("causal_ctx"), F.create_map().cast("map<string,string>"))
    return F.coalesce(
        F.when(col("id").isNull() | (canonical("id") == ZERO_ID), "zero id"),
        F.when(~F.coalesce(col("space").rlike(SPACE) & (_bytes(col("space")) <= MAX_SPACE), F.lit(False)), "bad space"),
        F.when(~F.coalesce(col("author_node").rlike(NODE), F.lit(False)), "bad node"),
        F.when(_bytes(col("author_agent")) == 0, "zero agent"),
        F.when(_bytes(col("author_model")) > MAX_NAME, "author_model too long"),
        F.when(_bytes(col("embed_model")) > MAX_NAME, "embed_model too long"),
        F.when(~F.coalesce(col("kind").isin(*KINDS), F.lit(False)), "bad kind"),
        F.when(~F.coalesce(col("evidence").isin(*EVIDENCE_RANK), F.lit(False)), "bad evidence"),
        F.when(_bytes(col("body")) > MAX_BODY, "body too long"),
        F.when(F.size(tags) > MAX_TAGS, "too many tags").when(F.exists(tags, lambda t: (_bytes(t) == 0) | (_bytes(t) > MAX_TAG)), "bad tag").when(tags != F.array_sort(F.array_distinct(tags)), "tags not sorted and unique"),
        edges("supersedes"),
        F.when(col("kind").isin(*SUPERSEDING_KINDS) & (size("supersedes") == 0), "nothing superseded"),
        edges("refs"),
        F.when((col("kind") == "conflict") & (size("refs") < 2), "conflict needs two refs"),
        F.when(F.size(context) > MAX_CONTEXT, "causal context too large").when(F.exists(F.map_entries(context), lambda e: ~e["key"].rlike(NODE) | F.coalesce(canonical(e["value"]) == ZERO_ID, F.lit(True))), "bad causal context"),
    )
