"""Queries over the store's own operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.functions import clock, display, embed
from mnemolake.functions.ids import canonical, canonical_all, ulid_millis
from mnemolake.functions.text import tokens
from mnemolake.operators import catalog, recall, reports, spaces, vector_index
from mnemolake.operators import version_vectors as vv
from mnemolake.session import Scratch, setting
from mnemolake.sources import store
from mnemolake.sources.tables import table
from mnemolake.streaming import ingest as streaming
from mnemolake.streaming.mesh import Mesh

QUERY = "the nightly replica sweep dropped the checksum of a manifest"
CANON = "translate(upper({0}), 'OIL', '011')"
IDS = "list_distinct(list_transform(coalesce({0}, []), lambda x: translate(upper(x), 'OIL', '011')))"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

R = f"r AS (SELECT *, {CANON.format('id')} AS cid, {IDS.format('supersedes')} AS sup, {IDS.format('refs')} AS rf, split_part(space, '/', 1) AS cls FROM records)"
D = "d AS (SELECT DISTINCT space, unnest(sup) AS id FROM r)"


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "records")


def _replica(records: DataFrame) -> DataFrame:
    """A second replica that lacks every third record (by time) of all nodes but one letter's."""
    return records.where((F.pmod(F.col("hlc.wall"), F.lit(3)) != 0) | (F.col("author_node") < "nd-d"))


REPLICA = "l AS (SELECT * FROM records WHERE hlc.wall % 3 <> 0 OR author_node < 'nd-d')"
VV = "vl AS (SELECT space, author_node AS node, max({c}) AS high FROM l GROUP BY ALL), vp AS (SELECT space, author_node AS node, max({c}) AS high FROM records GROUP BY ALL)".format(c=CANON.format("id"))


# --- validation, normalisation, labels


@query(
    rf"""
WITH r AS (SELECT *, {CANON.format('id')} AS cid, coalesce(tags, []) AS tg, coalesce(supersedes, []) AS su, coalesce(refs, []) AS re, coalesce(causal_ctx, MAP {{}}) AS cc FROM records)
SELECT cid AS id, CASE
 WHEN cid IS NULL OR cid = repeat('0', 26) THEN 'zero id'
 WHEN NOT coalesce(regexp_full_match(space, '(agent|user|shared)/[A-Za-z0-9._-]+') AND strlen(space) <= 200, false) THEN 'bad space'
 WHEN NOT coalesce(regexp_full_match(author_node, '[A-Za-z0-9._-]{{1,128}}'), false) THEN 'bad node'
 WHEN coalesce(strlen(author_agent), 0) = 0 THEN 'zero agent' WHEN coalesce(strlen(author_model), 0) > 128 THEN 'author_model too long' WHEN coalesce(strlen(embed_model), 0) > 128 THEN 'embed_model too long'
 WHEN NOT coalesce(kind IN ('episode','fact','procedure','artifact_ref','tombstone','retraction','conflict'), false) THEN 'bad kind'
 WHEN NOT coalesce(evidence IN ('observed','asserted','derived'), false) THEN 'bad evidence'
 WHEN coalesce(strlen(body), 0) > 1048576 THEN 'body too long'
 WHEN len(tg) > 64 THEN 'too many tags' WHEN len(list_filter(tg, lambda t: coalesce(strlen(t), 0) = 0 OR strlen(t) > 128)) > 0 THEN 'bad tag' WHEN tg <> list_sort(list_distinct(tg)) THEN 'tags not sorted and unique'
 WHEN len(su) > 256 THEN 'too many supersedes' WHEN len(list_filter(su, lambda x: translate(upper(x), 'OIL', '011') = repeat('0', 26))) > 0 THEN 'zero id in supersedes' WHEN len(list_filter(su, lambda x: translate(upper(x), 'OIL', '011') = cid)) > 0 THEN 'self in supersedes'
 WHEN kind IN ('tombstone', 'retraction') AND len(su) = 0 THEN 'nothing superseded'
 WHEN len(re) > 256 THEN 'too many refs' WHEN len(list_filter(re, lambda x: translate(upper(x), 'OIL', '011') = repeat('0', 26))) > 0 THEN 'zero id in refs' WHEN len(list_filter(re, lambda x: translate(upper(x), 'OIL', '011') = cid)) > 0 THEN 'self in refs'
 WHEN kind = 'conflict' AND len(re) < 2 THEN 'conflict needs two refs'
 WHEN len(map_keys(cc)) > 512 THEN 'causal context too large' WHEN len(list_filter(map_entries(cc), lambda e: NOT regexp_full_match(e.key, '[A-Za-z0-9._-]{{1,128}}') OR coalesce(translate(upper(e.value), 'OIL', '011') = repeat('0', 26), true))) > 0 THEN 'bad causal context' END AS violation FROM r"""
)
def validate_records(spark: SparkSession, root: str) -> DataFrame:
    records = _records(spark, root)
    return records.select(canonical("id").alias("id"), schema.first_violation(records).alias("violation"))


@query("SELECT id, CASE WHEN len(tags) > 0 THEN array_to_string(list_sort(list_distinct(tags)), '|') END AS tags FROM records")
def normalize_tags(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).select("id", F.array_join(schema.normalized("tags"), "|").alias("tags"))


@query("SELECT space, CASE split_part(space, '/', 1) WHEN 'agent' THEN 'lww' WHEN 'user' THEN 'siblings-auto' ELSE 'siblings-manual' END AS policy, split_part(space, '/', 1) AS class, count(*) AS n, replace(space, '/', '__') AS folder FROM records GROUP BY ALL")
def space_policy(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).groupBy("space").agg(F.count("*").alias("n")).select("space", schema.policy("space").alias("policy"), schema.space_class("space").alias("class"), "n", store.space_to_folder(F.col("space")).alias("folder"))


@query("SELECT evidence, CASE evidence WHEN 'observed' THEN 3 WHEN 'asserted' THEN 2 WHEN 'derived' THEN 1 ELSE 0 END AS rank, count(*) AS n FROM records GROUP BY ALL")
def evidence_rank(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).groupBy("evidence").agg(F.count("*").alias("n")).select("evidence", schema.evidence_rank("evidence").alias("rank"), "n")


@query("SELECT id, CASE WHEN b <= 256 THEN 256 WHEN b <= 1024 THEN 1024 WHEN b <= 4096 THEN 4096 WHEN b <= 16384 THEN 16384 WHEN b <= 65536 THEN 65536 ELSE ((b + 65535) // 65536) * 65536 END AS bucket FROM (SELECT id, n + 1 + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS b FROM (SELECT id, bytes AS n FROM records))")
def size_buckets(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).select("id", display.padded_length(F.col("bytes")).alias("bucket"))


_UNITS = " ".join(f"WHEN bytes < {1024 ** (k + 1)} THEN printf('%.1f{u}', bytes / {1024**k}.0)" for k, u in enumerate(display.UNITS[:-1], 1))


@query(f"SELECT id, CASE WHEN bytes < 1024 THEN bytes || 'B' {_UNITS} WHEN bytes IS NOT NULL THEN printf('%.1f{display.UNITS[-1]}', bytes / {1024 ** len(display.UNITS)}.0) END AS size FROM records")
def human_sizes(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).select("id", display.human_bytes(F.col("bytes")).alias("size"))


@query("SELECT id, hlc.wall || '.' || hlc.counter AS clock, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 11), lambda i: (strpos('0123456789ABCDEFGHJKMNPQRSTVWXYZ', substr(translate(upper(id), 'OIL', '011'), i::INT, 1)) - 1)::BIGINT)), lambda a, b: a * 32 + b) AS id_millis FROM records")
def id_times(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).select("id", clock.hlc_text().alias("clock"), ulid_millis(F.col("id")).alias("id_millis"))


_AGE = "(bytes * 137 - 5000)"


@query(f"SELECT id, CASE WHEN s < 0 THEN 'never' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || s % 60 || 's' WHEN s < 86400 THEN s // 3600 || 'h' || (s % 3600) // 60 || 'm' ELSE s // 86400 || 'd' || (s % 86400) // 3600 || 'h' END AS duration FROM (SELECT id, {_AGE} AS s FROM records)")
def human_durations(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).select("id", display.human_duration(F.col("bytes") * 137 - 5000).alias("duration"))


@query(f"SELECT id, strlen(b) AS n, b AS data, CASE WHEN p <= 256 THEN 256 WHEN p <= 1024 THEN 1024 WHEN p <= 4096 THEN 4096 WHEN p <= 16384 THEN 16384 WHEN p <= 65536 THEN 65536 ELSE ((p + 65535) // 65536) * 65536 END AS padded, false AS torn FROM (SELECT id, b, strlen(b) + 1 + CASE WHEN strlen(b) < 128 THEN 1 WHEN strlen(b) < 16384 THEN 2 WHEN strlen(b) < 2097152 THEN 3 ELSE 4 END AS p FROM (SELECT id, coalesce(body, '') AS b FROM records))")
def padded_bodies(spark: SparkSession, root: str) -> DataFrame:
    """Every body padded and taken out again; with one more byte it is no bucket and does not come out."""
    rows = _records(spark, root).select("id", F.coalesce("body", F.lit("")).cast("binary").alias("b")).withColumn("p", display.pad(F.col("b")))
    torn = F.concat("p", F.lit(b"\x00"))
    return rows.select("id", F.octet_length("b").cast("bigint").alias("n"), display.unpad(F.col("p")).cast("string").alias("data"), F.octet_length("p").cast("bigint").alias("padded"), display.unpad(torn).isNotNull().alias("torn"))


_BITS = "array_to_string(list_transform(range(1, 65), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', substr(h, i::INT, 1)) - 1)::INT * 4 + 1, 4)), '') || '0000'"


@query(
    f"""WITH a AS (SELECT DISTINCT author_agent, sha256(author_agent) AS h FROM records WHERE author_agent IS NOT NULL), b AS (SELECT author_agent, {_BITS} AS bits FROM a),
t AS (SELECT author_agent, array_to_string(list_transform(range(0, 52), lambda k: substr('abcdefghijklmnopqrstuvwxyz234567', (list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substr(bits, (5 * k + j)::INT, 1) = '1' THEN 2 ** (5 - j) ELSE 0 END)) + 1)::INT, 1)), '') AS txt FROM b)
SELECT author_agent, 'ag_' || txt AS agent_text, 'rk_' || txt AS recipient_text, left(txt, 8) || '…' || right(txt, 4) AS fingerprint, true AS same FROM t"""
)
def agent_ids(spark: SparkSession, root: str) -> DataFrame:
    """Id texts of 32-byte keys, their fingerprints, and the way back."""
    keys = _records(spark, root).where(F.col("author_agent").isNotNull()).select("author_agent").distinct().withColumn("key", F.unhex(F.sha2("author_agent", 256)))
    texts = keys.withColumn("agent_text", display.agent_text(F.col("key"))).withColumn("recipient_text", display.recipient_text(F.col("key")))
    same = (display.parse_key(F.col("agent_text")) == F.col("key")) & (display.parse_key(F.col("recipient_text")) == F.col("key"))
    return texts.select("author_agent", "agent_text", "recipient_text", display.fingerprint(F.col("agent_text")).alias("fingerprint"), same.alias("same"))


@query("SELECT DISTINCT space, split_part(space, '/', 1) IN ('agent', 'user') AS auto_resolves, split_part(space, '/', 1) <> 'agent' AS keeps_siblings, split_part(replace(space, '/', '__'), '__', 1) || '/' || substr(replace(space, '/', '__'), strpos(replace(space, '/', '__'), '__') + 2) AS back FROM records")
def space_rules(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).select("space").distinct().select("space", schema.auto_resolves("space").alias("auto_resolves"), schema.keeps_siblings("space").alias("keeps_siblings"), store.folder_to_space(store.space_to_folder(F.col("space"))).alias("back"))


@query("SELECT DISTINCT author_agent, CASE WHEN trim(coalesce(author_agent, '')) = '' THEN 'default' ELSE author_agent END AS name, regexp_full_match(coalesce(author_agent, ''), '[A-Za-z0-9._-]{1,64}') AND author_agent NOT IN ('.', '..') AS valid FROM records WHERE author_agent IS NOT NULL")
def agent_names(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).where(F.col("author_agent").isNotNull()).select("author_agent").distinct().select("author_agent", schema.agent_or_default(F.col("author_agent")).alias("name"), schema.agent_name_valid(F.col("author_agent")).alias("valid"))


@query(f"SELECT {CANON.format('id')} AS id, space, kind, embed_model, bytes FROM records")
def metadata(spark: SparkSession, root: str) -> DataFrame:
    return catalog.metadata(_records(spark, root)).select("id", "space", "kind", "embed_model", "bytes")


# --- edges and liveness


@query(f"WITH {R}, {D} SELECT space, cid AS id, kind FROM r WHERE (space, cid) NOT IN (SELECT (space, id) FROM d WHERE id IS NOT NULL)")
def live_records(spark: SparkSession, root: str) -> DataFrame:
    return catalog.live(_records(spark, root)).select("space", "id", "kind")


@query(f"WITH {R}, {D} SELECT space, cid AS id, hlc.wall AS wall FROM r WHERE kind = 'fact' AND NOT EXISTS (SELECT 1 FROM d WHERE d.space = r.space AND d.id = r.cid) ORDER BY hlc.wall DESC, hlc.counter DESC, cid DESC LIMIT 50")
def live_by_kind(spark: SparkSession, root: str) -> DataFrame:
    return catalog.live_by_kind(_records(spark, root), "fact", 50).select("space", "id", F.col("hlc.wall").alias("wall"))


@query(f"WITH {R}, {D} SELECT space, cid AS id, hlc.wall AS wall FROM r WHERE list_contains(tags, 'nightly') AND NOT EXISTS (SELECT 1 FROM d WHERE d.space = r.space AND d.id = r.cid) ORDER BY hlc.wall DESC, hlc.counter DESC, cid DESC LIMIT 50")
def live_by_tag(spark: SparkSession, root: str) -> DataFrame:
    return catalog.live_by_tag(_records(spark, root), "nightly", 50).select("space", "id", F.col("hlc.wall").alias("wall"))


@query(f"WITH {R}, e AS (SELECT space, cid, unnest(sup) AS id FROM r) SELECT space, id, array_to_string(list_sort(list_distinct(list(cid))), ',') AS superseded_by FROM e GROUP BY space, id")
def superseded_by(spark: SparkSession, root: str) -> DataFrame:
    return catalog.superseded_by(_records(spark, root)).select("space", "id", F.array_join("superseded_by", ",").alias("superseded_by"))


@query(f"WITH {R}, e AS (SELECT space, cid, unnest(rf) AS id FROM r) SELECT space, id, array_to_string(list_sort(list_distinct(list(cid))), ',') AS referenced_by FROM e GROUP BY space, id")
def referenced_by(spark: SparkSession, root: str) -> DataFrame:
    return catalog.referenced_by(_records(spark, root)).select("space", "id", F.array_join("referenced_by", ",").alias("referenced_by"))


@query(f"WITH {R}, e AS (SELECT space, cid, hlc, body, unnest(sup) AS id FROM r WHERE kind = 'retraction') SELECT e.space, e.id, CAST(row_number() OVER (PARTITION BY e.space, e.id ORDER BY e.hlc.wall DESC, e.hlc.counter DESC, e.cid DESC) AS INT) AS position, e.cid AS retraction, e.body AS reason FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.space = e.space AND r.cid = e.id)")
def retractions(spark: SparkSession, root: str) -> DataFrame:
    return catalog.retractions(_records(spark, root))


@query(f"WITH {R}, e AS (SELECT space, cid, hlc, unnest(rf) AS id FROM r WHERE kind = 'conflict') SELECT e.space, e.id, CAST(row_number() OVER (PARTITION BY e.space, e.id ORDER BY e.hlc.wall DESC, e.hlc.counter DESC, e.cid DESC) AS INT) AS position, e.cid AS conflict FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.space = e.space AND r.cid = e.id)")
def conflicts(spark: SparkSession, root: str) -> DataFrame:
    return catalog.conflicts(_records(spark, root))


@query(f"WITH {R}, t AS (SELECT DISTINCT space, unnest(sup) AS id FROM r WHERE kind = 'tombstone') SELECT r.space, r.cid AS id FROM r JOIN t ON t.space = r.space AND t.id = r.cid")
def tombstoned(spark: SparkSession, root: str) -> DataFrame:
    return catalog.tombstoned(_records(spark, root))


_SIBLINGS = f"""
WITH {R}, {D}, c AS (SELECT space, cid AS via, hlc, rf, unnest(rf) AS id FROM r WHERE kind = 'conflict' AND len(rf) > 1),
m AS (SELECT h.space, h.cid AS id, h.author_node, c.via, c.hlc, unnest(c.rf) AS sibling FROM r h JOIN c ON c.space = h.space AND c.id = h.cid WHERE h.kind IN ('fact', 'procedure')),
o AS (SELECT * FROM m WHERE sibling <> id QUALIFY row_number() OVER (PARTITION BY space, id, sibling ORDER BY hlc.wall DESC, hlc.counter DESC, via DESC) = 1),
s AS (SELECT o.space, o.id, o.sibling, o.via, CAST(row_number() OVER (PARTITION BY o.space, o.id ORDER BY o.hlc.wall DESC, o.hlc.counter DESC, o.via DESC, o.sibling) AS INT) AS rn, coalesce({CANON.format('x.causal_ctx[o.author_node]')} >= o.id, false) AS saw_this_claim, x.evidence, count(*) OVER (PARTITION BY o.space, o.id) AS n
 FROM o JOIN r x ON x.space = o.space AND x.cid = o.sibling WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.space = o.space AND d.id = o.sibling))
"""


@query(_SIBLINGS + "SELECT space, id, sibling, via, rn, saw_this_claim, evidence, CAST(greatest(n - 4, 0) AS BIGINT) AS more FROM s WHERE rn <= 4")
def siblings(spark: SparkSession, root: str) -> DataFrame:
    return catalog.siblings(_records(spark, root)).drop("sibling_kind")


@query(_SIBLINGS + "SELECT saw_this_claim, evidence, count(*) AS n FROM s GROUP BY ALL")
def saw_this_claim(spark: SparkSession, root: str) -> DataFrame:
    return catalog.all_siblings(_records(spark, root)).groupBy("saw_this_claim", "evidence").agg(F.count("*").alias("n"))


@query(f"WITH {R}, {D} SELECT space, id FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.space = d.space AND r.cid = d.id)")
def pending_supersessions(spark: SparkSession, root: str) -> DataFrame:
    return catalog.pending_supersessions(_records(spark, root))


@query(f"WITH {R}, {D} SELECT r.space, r.kind, count(*) FILTER (d.id IS NULL) AS n_live FROM r LEFT JOIN d ON d.space = r.space AND d.id = r.cid GROUP BY ALL")
def counts_by_kind(spark: SparkSession, root: str) -> DataFrame:
    return catalog.counts_by_kind(_records(spark, root))


@query("SELECT embed_model, count(*) AS n FROM records GROUP BY ALL")
def embed_models(spark: SparkSession, root: str) -> DataFrame:
    return catalog.embed_models(_records(spark, root))


@query("SELECT author_agent, count(*) AS n FROM records GROUP BY ALL")
def agents(spark: SparkSession, root: str) -> DataFrame:
    return catalog.agents(_records(spark, root))


# --- spaces and keys

_UNREADABLE = "(SELECT space, count(*) AS lost FROM records WHERE space IN (SELECT space FROM space_keys) AND (space, epoch) NOT IN (SELECT (space, epoch) FROM space_keys) GROUP BY ALL)"


@query(
    f"""
WITH {R}, {D}, b AS (SELECT space, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT author_node) AS nodes FROM records GROUP BY ALL),
k AS (SELECT r.space, r.kind, count(*) FILTER (d.id IS NULL) AS n FROM r LEFT JOIN d ON d.space = r.space AND d.id = r.cid GROUP BY ALL),
l AS (SELECT space, CAST(sum(n) AS BIGINT) AS live, coalesce(array_to_string(list_sort(list(kind || ':' || n) FILTER (n > 0)), ' '), '') AS by_kind FROM k GROUP BY ALL),
p AS (SELECT space, count(*) AS pending FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.space = d.space AND r.cid = d.id) GROUP BY ALL),
h AS (SELECT space, max(epoch) AS epoch FROM space_keys GROUP BY ALL)
SELECT b.space, CASE split_part(b.space, '/', 1) WHEN 'agent' THEN 'lww' WHEN 'user' THEN 'siblings-auto' ELSE 'siblings-manual' END AS policy, h.epoch IS NOT NULL AS readable, records, bytes, nodes, h.epoch,
CASE WHEN h.epoch IS NOT NULL THEN live END AS live, CASE WHEN h.epoch IS NOT NULL THEN by_kind END AS by_kind, CASE WHEN h.epoch IS NOT NULL THEN coalesce(pending, 0) END AS pending, CASE WHEN h.epoch IS NOT NULL THEN coalesce(lost, 0) END AS undecryptable
FROM b LEFT JOIN l USING (space) LEFT JOIN p USING (space) LEFT JOIN h USING (space) LEFT JOIN {_UNREADABLE} u USING (space)"""
)
def list_spaces(spark: SparkSession, root: str) -> DataFrame:
    return spaces.list_spaces(_records(spark, root), table(spark, root, "space_keys"))


@query("SELECT space, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT author_node) AS nodes FROM records GROUP BY ALL")
def space_stats(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).groupBy("space").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.count_distinct("author_node").alias("nodes"))


@query(f"SELECT space, lost AS n_undecryptable FROM {_UNREADABLE}")
def undecryptable(spark: SparkSession, root: str) -> DataFrame:
    return spaces.undecryptable(_records(spark, root), table(spark, root, "space_keys"))


@query("SELECT space, max(epoch) AS current, array_to_string(list_sort(list(DISTINCT epoch)), ',') AS epochs FROM space_keys GROUP BY ALL")
def key_report(spark: SparkSession, root: str) -> DataFrame:
    return spaces.key_report(table(spark, root, "space_keys"))


@query("SELECT space, epoch, epoch = max(epoch) OVER (PARTITION BY space) AS is_current FROM (SELECT space, epoch FROM space_keys UNION ALL SELECT 'shared/fresh', 0)")
def key_rotation(spark: SparkSession, root: str) -> DataFrame:
    return spaces.install(table(spark, root, "space_keys"), "shared/fresh", 0)


@query("SELECT id, body, (space, epoch) NOT IN (SELECT (space, epoch) FROM space_keys) AS lost FROM (SELECT id, space, epoch, CASE WHEN (space, epoch) IN (SELECT (space, epoch) FROM space_keys) THEN coalesce(body, '') END AS body FROM records)")
def sealed_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Every body sealed under its epoch's key and opened with the keys held; without the key it stays shut."""
    held = table(spark, root, "space_keys").select("space", "epoch").distinct().withColumn("key", F.substring(F.sha2(F.concat_ws(":", "space", F.col("epoch").cast("string")), 256), 1, 32).cast("binary"))
    aad = spaces.record_aad(F.col("space"), F.col("id"), F.col("author_node"), F.col("epoch"))
    true_key = F.substring(F.sha2(F.concat_ws(":", "space", F.col("epoch").cast("string")), 256), 1, 32).cast("binary")
    sealed = _records(spark, root).select("id", "space", "epoch", "author_node", spaces.seal(F.coalesce("body", F.lit("")).cast("binary"), true_key, aad).alias("blob"))
    opened = sealed.join(held, ["space", "epoch"], "left").withColumn("body", spaces.open_sealed(F.col("blob"), F.coalesce("key", F.lit("0" * 32).cast("binary")), aad).cast("string"))
    return opened.select("id", "body", F.col("body").isNull().alias("lost"))


# --- version vectors and deltas


@query(f"SELECT space, author_node AS node, max({CANON.format('id')}) AS high FROM records GROUP BY ALL")
def version_vector(spark: SparkSession, root: str) -> DataFrame:
    return vv.version_vector(_records(spark, root))


@query(f"WITH v AS (SELECT space, author_node AS node, max({CANON.format('id')}) AS high FROM records GROUP BY ALL) SELECT space, '{{' || array_to_string(list_sort(list(node || ':' || high)), ', ') || '}}' AS vector_text FROM v GROUP BY space")
def vector_text(spark: SparkSession, root: str) -> DataFrame:
    return vv.vector_text(vv.version_vector(_records(spark, root)))


def _both(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    peer = _records(spark, root)
    return _replica(peer), peer


@query(f"WITH {REPLICA}, {VV} SELECT space, node, max(high) AS high FROM (SELECT * FROM vl UNION ALL SELECT * FROM vp) GROUP BY ALL")
def vector_merge(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.merge(vv.version_vector(mine), vv.version_vector(theirs))


@query(
    f"""WITH {REPLICA}, {VV}, f AS (SELECT coalesce(vl.space, vp.space) AS space, vl.high AS m, vp.high AS t FROM vl FULL JOIN vp ON vl.space = vp.space AND vl.node = vp.node),
c AS (SELECT space, count(*) FILTER (t IS NOT NULL AND (m IS NULL OR m < t)) AS b, count(*) FILTER (m IS NOT NULL AND (t IS NULL OR t < m)) AS a FROM f GROUP BY ALL)
SELECT space, b = 0 AS a_dominates, a = 0 AS b_dominates, a = 0 AND b = 0 AS equal, a > 0 AND b > 0 AS concurrent FROM c"""
)
def vector_dominates(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.compare(vv.version_vector(mine), vv.version_vector(theirs))


_RANGES = "g AS (SELECT vp.space, vp.node, coalesce(vl.high, repeat('0', 26)) AS after_id, vp.high AS through_id FROM vp LEFT JOIN vl ON vl.space = vp.space AND vl.node = vp.node WHERE vl.high IS NULL OR vl.high < vp.high)"


@query(f"WITH {REPLICA}, {VV}, {_RANGES} SELECT space, node, after_id AS after, through_id AS through FROM g")
def missing_ranges(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.missing_ranges(vv.version_vector(mine), vv.version_vector(theirs))


@query(f"WITH {REPLICA}, {VV}, {_RANGES} SELECT p.space, {CANON.format('p.id')} AS id FROM records p JOIN g ON g.space = p.space AND g.node = p.author_node WHERE {CANON.format('p.id')} > after_id AND {CANON.format('p.id')} <= through_id")
def delta_fetch(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.delta(theirs, vv.missing_ranges(vv.version_vector(mine), vv.version_vector(theirs))).select("space", "id")


@query(f"WITH {REPLICA}, {VV}, {_RANGES} SELECT p.space, {CANON.format('p.id')} AS id FROM records p JOIN g ON g.space = p.space AND g.node = p.author_node WHERE {CANON.format('p.id')} > after_id AND {CANON.format('p.id')} <= through_id QUALIFY row_number() OVER (PARTITION BY p.space ORDER BY p.author_node, {CANON.format('p.id')}) <= 256")
def delta_fetch_limited(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.delta_limited(theirs, vv.missing_ranges(vv.version_vector(mine), vv.version_vector(theirs))).select("space", "id")


@query(f"WITH {REPLICA} SELECT space, {CANON.format('id')} AS id FROM records p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.space = p.space AND {CANON.format('l.id')} = {CANON.format('p.id')})")
def set_reconcile(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.set_missing(mine, theirs).select("space", "id")


@query(
    f"""WITH {REPLICA}, {VV}, f AS (SELECT vl.high AS m, vp.high AS t FROM vl FULL JOIN vp ON vl.space = vp.space AND vl.node = vp.node WHERE coalesce(vl.space, vp.space) IN (SELECT space FROM vl) AND coalesce(vl.space, vp.space) IN (SELECT space FROM vp))
SELECT count(*) FILTER (t IS NOT NULL AND (m IS NULL OR m < t)) AS lag_behind, count(*) FILTER (m IS NOT NULL AND (t IS NULL OR t < m)) AS lag_ahead FROM f"""
)
def lag(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.lag(vv.version_vector(mine), vv.version_vector(theirs))


@query("SELECT DISTINCT r.space FROM records r JOIN space_keys k ON k.space = r.space")
def common_spaces(spark: SparkSession, root: str) -> DataFrame:
    return vv.common_spaces(_records(spark, root), table(spark, root, "space_keys"))


@query(f"WITH {REPLICA}, {VV}, {_RANGES} SELECT space, count(*) AS n FROM (SELECT space, {CANON.format('id')} AS id FROM l UNION SELECT p.space, {CANON.format('p.id')} FROM records p JOIN g ON g.space = p.space AND g.node = p.author_node WHERE {CANON.format('p.id')} > after_id AND {CANON.format('p.id')} <= through_id) GROUP BY ALL")
def exchange(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.exchange(mine, theirs).groupBy("space").agg(F.count("*").alias("n"))


@query(_SQL["exchange"])
def exchange_bounded(spark: SparkSession, root: str) -> DataFrame:
    """The same in rounds of at most 256 records a space."""
    mine, theirs = _both(spark, root)
    return vv.exchange(mine, theirs, batch=vv.BATCH).groupBy("space").agg(F.count("*").alias("n"))


@query(f"WITH {REPLICA}, {VV} SELECT coalesce(vl.space, vp.space) AS space, coalesce(vl.node, vp.node) AS node, greatest(vl.high, vp.high) AS high, vl.high IS NULL OR vl.high < greatest(vl.high, vp.high) AS changed FROM vl FULL JOIN vp ON vl.space = vp.space AND vl.node = vp.node")
def vector_merge_changed(spark: SparkSession, root: str) -> DataFrame:
    mine, theirs = _both(spark, root)
    return vv.merge_changed(vv.version_vector(mine), vv.version_vector(theirs))


def _mesh(spark: SparkSession, root: str) -> Mesh:
    """Two stores: ``a`` lacks what the replica lacks, ``b`` holds everything."""
    scratch = Scratch(spark, "mesh")
    stores = {n: store.RecordStore(spark, scratch.at(n)) for n in ("a", "b", "c")}
    mine, theirs = _both(spark, root)
    stores["a"].append(mine)
    stores["b"].append(theirs)
    return Mesh(spark, stores)


@query(f"WITH {REPLICA}, {VV}, {_RANGES} SELECT 'b' AS peer, count(*) AS pulled, NULL AS error FROM records p JOIN g ON g.space = p.space AND g.node = p.author_node WHERE {CANON.format('p.id')} > after_id AND {CANON.format('p.id')} <= through_id UNION ALL SELECT 'c', 0, 'offline'")
def sync_report(spark: SparkSession, root: str) -> DataFrame:
    """A forced round of a node with two peers, one of them cut off."""
    mesh = _mesh(spark, root)
    mesh.cut("a", "c")
    return mesh.sync_now("a").select("peer", "pulled", "error")


@query(f"SELECT node, space, author_node, max({CANON.format('id')}) AS high, count(*) AS n FROM records, (VALUES ('b'), ('c')) AS t(node) GROUP BY ALL")
def convergence(spark: SparkSession, root: str) -> DataFrame:
    """A node that held nothing, and one that was cut off from it at first, have the same records and marks in the end."""
    mesh = _mesh(spark, root)
    mesh.cut("c", "b")
    mesh.pull("c", "a")
    mesh.heal()
    mesh.stores["c"].append(vv.set_missing(mesh.stores["c"].read(), mesh.stores["b"].read()))  # marks leave holes, exact reconciliation none
    mesh.pull("b", "c")
    held = [mesh.stores[n].read().withColumn("node", F.lit(n)) for n in ("b", "c")]
    return held[0].unionByName(held[1]).groupBy("node", "space", "author_node").agg(F.max("id").alias("high"), F.count("*").alias("n"))


# --- store


@query("SELECT id, space FROM records WHERE author_node = 'nd-nendlus-01' AND id > '01K5' AND id <= '01KC' ORDER BY id LIMIT 100")
def range_scan(spark: SparkSession, root: str) -> DataFrame:
    return store.range_scan(_records(spark, root), "nd-nendlus-01", "01K5", "01KC", 100).select("id", "space")


@query(f"SELECT coalesce(max({CANON.format('id')}), repeat('0', 26)) AS max_id FROM records WHERE author_node = 'nd-nendlus-01'")
def max_local_id(spark: SparkSession, root: str) -> DataFrame:
    return store.max_local_id(_records(spark, root), "nd-nendlus-01")


@query(f"WITH {REPLICA} SELECT DISTINCT space, {CANON.format('id')} AS id FROM records p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.space = p.space AND {CANON.format('l.id')} = {CANON.format('p.id')})")
def idempotent_append(spark: SparkSession, root: str) -> DataFrame:
    """What an append of everything, twice over, adds to the replica."""
    mine, theirs = _both(spark, root)
    return store.new_rows(mine, theirs.unionByName(theirs)).select("space", "id")


@query("SELECT id, space, true AS held FROM records WHERE id = (SELECT max(id) FROM records)")
def point_lookup(spark: SparkSession, root: str) -> DataFrame:
    """The newest record by the lower-case spelling of its id, and whether it is held."""
    records = _records(spark, root)
    last = records.agg(F.max("id")).first()[0] or ""
    return store.point_lookup(records, last.lower()).select("id", "space", store.exists(records, last.lower()).scalar().alias("held"))


@query("SELECT space, count(*) AS n, 1::BIGINT AS segments FROM records GROUP BY ALL")
def store_compacted(spark: SparkSession, root: str) -> DataFrame:
    """A store written in four appends, compacted to one file a space."""
    held = store.RecordStore(spark, Scratch(spark, "compacted").at("store"))
    for k in range(4):
        held.append(_records(spark, root).where(F.pmod(F.col("hlc.wall"), F.lit(4)) == k))
    held.compact(most_files=1)
    return held.read().groupBy("space").agg(F.count("*").alias("n")).join(held.segments(), "space")


@query(f"SELECT DISTINCT space, {CANON.format('id')} AS id FROM deliveries WHERE id IS NOT NULL AND space IS NOT NULL")
def relay_sealed(spark: SparkSession, root: str) -> DataFrame:
    """Sealed entries taken unread, twice over: each (space, id) is kept once."""
    held = store.RecordStore(spark, Scratch(spark, "relay").at("store"))
    for _ in range(2):
        held.accept_sealed(table(spark, root, "deliveries"))
    return held.sealed().select("space", "id")


@query("SELECT space, epoch, epoch = max(epoch) OVER (PARTITION BY space) AS is_current FROM (SELECT DISTINCT space, epoch FROM space_keys)")
def keyring_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spaces.restore(spaces.snapshot(table(spark, root, "space_keys")))


# --- embedding, index, recall

TOK = rf"list_filter(regexp_split_to_array(lower({{0}}), '[^\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda x: strlen(x) > 1 OR regexp_full_match(x, '\p{{{{N}}}}+'))"


def tok(text: str) -> str:
    return TOK.format(text).replace("{{", "{").replace("}}", "}")


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tok('text')} AS t FROM documents WHERE text IS NOT NULL)")
def embed_tokens(spark: SparkSession, root: str) -> DataFrame:
    t = tokens(F.col("text"))
    return table(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def _features_sql(source: str) -> str:
    """CTEs from (key..., txt) rows of ``source`` to z(key, vec FLOAT[]): the embedder in SQL."""
    return f"""
w AS (SELECT key, {tok('txt')} AS t FROM {source}),
u AS (SELECT key, pos, feature FROM (SELECT key, unnest(list_transform(range(1, len(t) + 1), lambda i: {{'pos': 2 * i, 'feature': t[i]}}), recursive := true) FROM w)
  UNION ALL SELECT key, pos, feature FROM (SELECT key, unnest(list_transform(range(1, len(t)), lambda i: {{'pos': 2 * i + 1, 'feature': t[i] || chr(0) || t[i + 1]}}), recursive := true) FROM w)),
q AS (SELECT DISTINCT feature FROM u),
h AS (SELECT feature, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, strlen(feature)), lambda i: ('0x' || substr(hex(feature), (2 * i + 1)::INT, 2))::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS h FROM q),
bk AS (SELECT key, CAST(h % 384 AS INT) AS bucket, count(*) AS n, arg_max(CASE WHEN h >= 9223372036854775808 THEN -1 ELSE 1 END, pos) AS sign FROM u JOIN h USING (feature) GROUP BY ALL)"""


_VEC = """,
wt AS (SELECT key, bucket, CAST((1 + ln(n)) * sign AS FLOAT) AS x FROM bk), nm AS (SELECT key, CAST(1 / sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE) ORDER BY bucket)) AS FLOAT) AS inv FROM wt GROUP BY key),
v AS (SELECT key, bucket, CAST(x * inv AS FLOAT) AS x FROM wt JOIN nm USING (key))"""


@query(f"WITH s AS (SELECT doc_id AS key, text AS txt FROM documents WHERE text IS NOT NULL), {_features_sql('s')} SELECT key AS doc_id, bucket, n, sign FROM bk")
def embed_buckets(spark: SparkSession, root: str) -> DataFrame:
    return embed.buckets(table(spark, root, "documents").where(F.col("text").isNotNull()), "doc_id", F.col("text"))


@query(f"WITH s AS (SELECT doc_id AS key, text AS txt FROM documents WHERE text IS NOT NULL), {_features_sql('s')}{_VEC} SELECT key AS doc_id, count(*) AS n_buckets, CAST(sum(bucket * round(CAST(x AS DOUBLE), 4) * 10000) AS BIGINT) AS checksum FROM v GROUP BY key")
def embed_vectors_rounded(spark: SparkSession, root: str) -> DataFrame:
    v = embed.vectors(table(spark, root, "documents").where(F.col("text").isNotNull()), ["doc_id"], F.col("text"))
    cells = F.transform("vec", lambda x, i: F.round(i * F.round(x.cast("double"), 4) * 10000).cast("bigint"))
    return v.select("doc_id", F.size(F.filter("vec", lambda x: x != 0)).cast("bigint").alias("n_buckets"), F.aggregate(cells, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("checksum"))


_Q8 = "list_transform({0}, lambda x: CAST(round(greatest(-127.0, least(127.0, CAST(x AS DOUBLE) * 127.0))) AS INT))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: {2}))"


_TOPK_ALL = f"""WITH e AS (SELECT vec_id, embedding AS v, {_Q8.format('embedding')} AS v8 FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CAST({_DOT.format('e.v8', 'q.v8', 'p[1] * p[2]')} AS INT) AS q_dot, {_DOT.format('e.v', 'q.v', 'CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)')} AS dot FROM e, e q WHERE q.vec_id % 50 = 0),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY q_dot DESC, vec_id) <= 32) """


@query(_TOPK_ALL + "SELECT query_id, vec_id, q_dot FROM c")
def vector_topk_int8(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return vector_index.pooled_by_query(e, "embedding", e.where(F.col("vec_id") % 50 == 0), 8, "vec_id").select("query_id", "vec_id", "q_dot")


@query(_TOPK_ALL + "SELECT query_id, vec_id, round(dot, 4) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, vec_id) <= 8")
def vector_topk_rerank(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return vector_index.top_k_by_query(e, "embedding", e.where(F.col("vec_id") % 50 == 0), 8, "vec_id").select("query_id", "vec_id", F.round("dot", 4).alias("score"))


@cache
def _recall_sql(extra: str, superseded: str = "AND NOT superseded", least: float = 0.0) -> str:
    source = f"(SELECT {{'space': space, 'id': {CANON.format('id')}}} AS key, concat_ws(' ', coalesce(body, ''), array_to_string(tags, ' ')) AS txt FROM records WHERE kind NOT IN ('tombstone', 'conflict') UNION ALL SELECT {{'space': '', 'id': 'query'}}, '{QUERY}')"
    return f"""WITH {R}, {D}, {_features_sql(source)}{_VEC},
qv AS (SELECT bucket, x FROM v WHERE key.id = 'query'),
v8 AS (SELECT key, bucket, x, CAST(round(greatest(-127.0, least(127.0, CAST(x AS DOUBLE) * 127.0))) AS INT) AS x8 FROM v),
sc AS (SELECT a.key.space AS space, a.key.id AS id, coalesce(sum(a.x8 * b.x8), 0) AS q_dot, coalesce(sum(CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)), 0) AS score FROM v8 a LEFT JOIN (SELECT * FROM v8 WHERE key.id = 'query') b ON a.bucket = b.bucket WHERE a.key.id <> 'query' GROUP BY ALL),
p AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY space ORDER BY q_dot DESC, id) <= 144),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY space ORDER BY score DESC, id) <= 36),
f AS (SELECT k.space, k.id, r.kind, k.score, r.tags, EXISTS (SELECT 1 FROM d WHERE d.space = k.space AND d.id = k.id) AS superseded FROM k JOIN r ON r.space = k.space AND r.cid = k.id WHERE k.score >= {least})
SELECT space, id, kind, round(score, 4) AS score, superseded FROM f WHERE true {superseded} {extra} ORDER BY f.score DESC, id LIMIT 8"""


def _recall(spark: SparkSession, root: str, **more: object) -> DataFrame:
    return recall.recall(_records(spark, root), QUERY, **more).select("space", "id", "kind", F.round("score", 4).alias("score"), "superseded")


@query(_recall_sql(""))
def recall_basic(spark: SparkSession, root: str) -> DataFrame:
    return _recall(spark, root)


@query(_recall_sql("AND kind = 'fact'"))
def recall_kind_filter(spark: SparkSession, root: str) -> DataFrame:
    return _recall(spark, root, kinds=["fact"])


@query(_recall_sql("AND list_contains(tags, 'nightly')"))
def recall_tag_filter(spark: SparkSession, root: str) -> DataFrame:
    return _recall(spark, root, tags=["nightly"])


@query(_recall_sql("", ""))
def recall_include_superseded(spark: SparkSession, root: str) -> DataFrame:
    return _recall(spark, root, include_superseded=True)


@query(_recall_sql("", least=0.3))
def recall_min_score(spark: SparkSession, root: str) -> DataFrame:
    return _recall(spark, root, min_score=0.3)


@cache
def _kept_index(spark: SparkSession, app: str, root: str) -> vector_index.VectorIndex:
    """The index of a folder's records, written once an application and read by every search."""
    index = vector_index.VectorIndex(spark, Scratch(spark, "index").at("vectors"))
    index.warm(table(spark, root, "records"))
    return index


def _index(spark: SparkSession, root: str) -> vector_index.VectorIndex:
    return _kept_index(spark, spark.sparkContext.applicationId, root)


@query(_recall_sql(""))
def recall_indexed(spark: SparkSession, root: str) -> DataFrame:
    """``recall_basic`` on a kept index: the codes are scanned, vectors are fetched for the candidates only."""
    return _recall(spark, root, index=_index(spark, root))


@query("SELECT count(*) AS vectors, count(*) * (384 + 16 + 24) AS resident_bytes FROM (SELECT id FROM records WHERE kind NOT IN ('tombstone', 'conflict') AND len(" + tok("concat_ws(' ', coalesce(body, ''), array_to_string(tags, ' '))") + ") > 0)")
def index_totals(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).totals()


_HITS = _recall_sql("", "")
_ANNOTATED = f"""WITH h AS (SELECT * FROM ({_HITS})), b AS (SELECT * FROM ({_SQL["superseded_by"]})), t AS (SELECT space, id, array_to_string(list(reason ORDER BY position), '|') AS retractions FROM ({_SQL["retractions"]}) GROUP BY ALL),
g AS (SELECT space, id, array_to_string(list(sibling || '<' || via || '<' || saw_this_claim || '<' || evidence ORDER BY rn), '|') AS siblings, any_value(more) AS more FROM ({_SQL["siblings"]}) GROUP BY ALL),
f AS (SELECT h.space, h.id, h.kind, h.score, h.superseded, superseded_by, retractions, siblings, coalesce(more, 0) AS more_siblings FROM h LEFT JOIN b USING (space, id) LEFT JOIN t USING (space, id) LEFT JOIN g USING (space, id))"""


def _annotated(spark: SparkSession, root: str) -> DataFrame:
    records = _records(spark, root)
    return recall.annotated(records, recall.recall(records, QUERY, include_superseded=True, index=_index(spark, root)))


@query(_ANNOTATED + " SELECT * FROM f")
def recall_annotated(spark: SparkSession, root: str) -> DataFrame:
    side = lambda e: F.concat_ws("<", e["sibling"], e["via"], e["saw_this_claim"].cast("string"), e["evidence"])
    return _annotated(spark, root).select("space", "id", "kind", F.round("score", 4).alias("score"), "superseded", F.array_join("superseded_by", ",").alias("superseded_by"), F.array_join("retractions", "|").alias("retractions"), F.array_join(F.transform("siblings", side), "|").alias("siblings"), "more_siblings")


@query(
    _ANNOTATED
    + f""", e AS (SELECT DISTINCT embed_model AS m FROM records)
SELECT 'the index is not complete yet; results may be missing' AS warning UNION ALL SELECT 'records embedded by other models are held: ' || array_to_string(list(m ORDER BY m) FILTER (m <> '{embed.MODEL}'), ', ') FROM e HAVING count(*) > 1
UNION ALL SELECT * FROM (SELECT 'record ' || id || ' has ' || more_siblings || ' further contradicting siblings' FROM f WHERE more_siblings > 0 ORDER BY score DESC, id LIMIT 1)"""
)
def recall_warnings(spark: SparkSession, root: str) -> DataFrame:
    return recall.warnings(_records(spark, root), _annotated(spark, root), warm=False)


@query(
    """WITH asked AS (SELECT DISTINCT space FROM records UNION SELECT DISTINCT space FROM space_keys)
SELECT space, CASE WHEN space NOT IN (SELECT space FROM records) THEN 'not held' WHEN space NOT IN (SELECT space FROM space_keys) THEN 'relayed' WHEN space NOT IN (SELECT space FROM ix) THEN 'not indexed' END AS reason
FROM asked, (SELECT 1) WHERE reason IS NOT NULL""".replace("WITH asked", "WITH ix AS (SELECT DISTINCT space FROM records WHERE kind NOT IN ('tombstone', 'conflict') AND len(" + tok("concat_ws(' ', coalesce(body, ''), array_to_string(tags, ' '))") + ") > 0), asked")
)
def recall_skipped(spark: SparkSession, root: str) -> DataFrame:
    records = _records(spark, root)
    asked = records.select("space").union(table(spark, root, "space_keys").select("space")).distinct()
    return recall.skipped_spaces(asked, records, table(spark, root, "space_keys"), _index(spark, root).read())


@query("SELECT a.vec_id AS vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 50")
def vector_cosine(spark: SparkSession, root: str) -> DataFrame:
    """Every vector against the last one before it whose id is divisible by 50."""
    e = table(spark, root, "embeddings")
    heads = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("head"), F.col("embedding").alias("other"))
    return e.withColumn("head", F.col("vec_id") - F.col("vec_id") % 50).join(heads, "head").select("vec_id", F.round(embed.dot(F.col("embedding"), F.col("other")), 4).alias("cosine"))


# --- reports

_MEMBERS = "m AS (SELECT coalesce(p.node, w.node) AS node, coalesce(p.enrolled, false) AS enrolled, w.node IS NOT NULL AS participating, p.transport, coalesce(p.clock_skew_ms, 0) AS clock_skew_ms, coalesce(CASE WHEN p.last_contact IS NULL THEN -1 ELSE (epoch_us(p.as_of) - epoch_us(p.last_contact)) // 1000000 END, -1) AS contact_age_s FROM peers p FULL JOIN (SELECT DISTINCT author_node AS node FROM records WHERE author_node IS NOT NULL) w ON w.node = p.node)"


@query(f"WITH {_MEMBERS} SELECT * FROM m")
def members(spark: SparkSession, root: str) -> DataFrame:
    return reports.members(_records(spark, root), table(spark, root, "peers")).select("node", "enrolled", "participating", "transport", "clock_skew_ms", "contact_age_s")


@query("SELECT coalesce(ms, 0) AS worst_ms, CASE WHEN ms > 0 THEN node ELSE '' END AS worst_node, CASE WHEN ms >= 30000 THEN 'critical' WHEN ms >= 2000 THEN 'warn' ELSE 'ok' END AS severity FROM (SELECT abs(coalesce(clock_skew_ms, 0)) AS ms, node FROM peers ORDER BY 1 DESC, node LIMIT 1)")
def clock_skew(spark: SparkSession, root: str) -> DataFrame:
    return reports.clock_skew(table(spark, root, "peers"))


@query(
    f"""WITH {R}, {D}, {_MEMBERS},
x AS (SELECT r.kind, d.id IS NULL AS live FROM r LEFT JOIN d ON d.space = r.space AND d.id = r.cid),
c AS (SELECT count(*) AS n, count(*) FILTER (live AND kind NOT IN ('tombstone', 'conflict')) AS ix, count(*) FILTER (kind NOT IN ('tombstone', 'conflict')) AS vs, count(*) FILTER (live AND kind = 'conflict') AS cf FROM x),
a AS (SELECT CASE WHEN last_contact IS NULL THEN 1 WHEN (epoch_us(as_of) - epoch_us(last_contact)) // 1000000 >= 3600 THEN 2 WHEN (epoch_us(as_of) - epoch_us(last_contact)) // 1000000 >= 600 THEN 1 ELSE 0 END AS lv FROM peers),
e AS (SELECT (SELECT count(*) FROM peers WHERE embed_model <> '' AND embed_model <> 'hashbag-v1-384') AS pm, (SELECT count(DISTINCT embed_model) FROM records WHERE embed_model <> '' AND embed_model <> 'hashbag-v1-384') AS hm)
SELECT 'daemon' AS "check", 'ok' AS severity, 0::BIGINT AS value UNION ALL SELECT 'store', 'ok', n FROM c
UNION ALL SELECT 'index', CASE WHEN ix > 0 AND vs = 0 THEN 'critical' WHEN vs < ix * 9 // 10 THEN 'warn' WHEN vs * 424 > 536870912 THEN 'warn' ELSE 'ok' END, vs FROM c
UNION ALL SELECT 'torn-tail', 'ok', 0 UNION ALL SELECT 'clock-skew', CASE WHEN ms >= 30000 THEN 'critical' WHEN ms >= 2000 THEN 'warn' ELSE 'ok' END, ms FROM (SELECT max(abs(coalesce(clock_skew_ms, 0))) AS ms FROM peers)
UNION ALL SELECT 'embed-model', CASE WHEN pm > 0 OR hm > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN pm > 0 THEN pm ELSE hm END FROM e
UNION ALL SELECT 'key-epoch', CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END, n FROM (SELECT CAST(coalesce(sum(lost), 0) AS BIGINT) AS n FROM {_UNREADABLE})
UNION ALL SELECT 'unsendable', CASE WHEN count(*) > 0 THEN 'warn' ELSE 'ok' END, count(*) FROM records WHERE space NOT IN (SELECT space FROM space_keys)
UNION ALL SELECT 'outbound-queue', 'ok', 0 UNION ALL SELECT 'peer-reachability', CASE max(lv) WHEN 2 THEN 'critical' WHEN 1 THEN 'warn' ELSE 'ok' END, count(*) FILTER (lv > 0) FROM a
UNION ALL SELECT 'participants', CASE WHEN count(*) FILTER (enrolled) = 0 THEN 'skipped' WHEN count(*) FILTER (enrolled AND NOT participating) > 0 THEN 'warn' ELSE 'ok' END, count(*) FILTER (enrolled AND NOT participating) FROM m
UNION ALL SELECT 'conflict-backlog', CASE WHEN cf >= 20 THEN 'warn' ELSE 'ok' END, cf FROM c"""
)
def health(spark: SparkSession, root: str) -> DataFrame:
    return reports.health(_records(spark, root), table(spark, root, "peers"), table(spark, root, "space_keys")).select("check", "severity", "value")


@query(
    f"""WITH {_MEMBERS} SELECT count(DISTINCT space) AS spaces, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT author_agent) AS agents,
(SELECT count(DISTINCT r.space) FROM records r JOIN space_keys k ON k.space = r.space) AS readable, (SELECT count(DISTINCT space) FROM records WHERE space NOT IN (SELECT space FROM space_keys)) AS relayed, (SELECT count(*) FROM m WHERE enrolled) AS enrolled, (SELECT count(*) FROM m WHERE participating) AS participating FROM records"""
)
def status(spark: SparkSession, root: str) -> DataFrame:
    return reports.status(_records(spark, root), table(spark, root, "peers"), table(spark, root, "space_keys"))


@query("SELECT node AS name, key, count(r.author_agent) AS n FROM (SELECT node, unnest(agent_keys) AS key FROM peers) p LEFT JOIN records r ON r.author_agent = p.key GROUP BY ALL")
def agent_records(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "peers").select(F.col("node").alias("name"), F.explode("agent_keys").alias("key"))
    return reports.agent_records(names, _records(spark, root))


@query("SELECT coalesce(d.node, p.node) AS node, coalesce(nullif(p.address, ''), d.address) AS address FROM (SELECT DISTINCT author_node AS node, 'host-' || author_node AS address FROM records WHERE author_node IS NOT NULL) d FULL JOIN peers p ON p.node = d.node")
def known_peers(spark: SparkSession, root: str) -> DataFrame:
    found = _records(spark, root).where(F.col("author_node").isNotNull()).select("author_node").distinct().select(F.col("author_node").alias("node"), F.concat(F.lit("host-"), "author_node").alias("address"))
    return reports.known_peers(found, table(spark, root, "peers"))


@query("SELECT regexp_replace(h, '[^A-Za-z0-9._-]', '-', 'g') AS node, a AS address, t AS transport, online FROM (SELECT CASE WHEN enrolled THEN node || ' x' ELSE split_part(node || '.net.example', '.', 1) END AS h, address AS a, CASE WHEN coalesce(transport, '') = 'direct' THEN 'direct' ELSE 'derp' END AS t, last_contact IS NOT NULL AS online FROM peers WHERE enrolled IS NOT NULL AND address IS NOT NULL AND node LIKE '%n%')")
def discovered_peers(spark: SparkSession, root: str) -> DataFrame:
    hosts = table(spark, root, "peers").where(F.col("enrolled").isNotNull()).select(
        F.when(F.col("enrolled"), F.concat("node", F.lit(" x"))).otherwise("").alias("hostname"), F.concat("node", F.lit(".net.example")).alias("dns_name"), F.array_compact(F.array("address")).alias("ips"),
        F.when(F.contains("node", F.lit("n")), F.array(F.lit("tag:mesh"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.col("last_contact").isNotNull().alias("online"), F.when(F.col("transport") == "direct", "1.2.3.4:5").alias("cur_addr"),
    )
    return reports.discovered_peers(hosts, "tag:mesh")


@query("SELECT least(3, count(*)) AS picked, least(3, count(*)) AS known FROM peers")
def picked_peers(spark: SparkSession, root: str) -> DataFrame:
    """How many of the peers a push picks, and how many of those are peers at all."""
    peers = table(spark, root, "peers")
    chosen = Scratch(spark, "picked").write(reports.pick_peers(peers.select("node"), 3), "picked")
    return chosen.agg(F.count("*").alias("picked")).select("picked", chosen.join(peers.select("node"), "node", "left_semi").agg(F.count("*")).scalar().alias("known"))


@query("SELECT node, list_max(list_filter([epoch_ms(as_of) % 3, coalesce(clock_skew_ms, 0) % 4, 7], lambda v: v BETWEEN 1 AND 1)) AS version FROM peers")
def negotiated(spark: SparkSession, root: str) -> DataFrame:
    offered = F.array(F.unix_millis(F.col("as_of").cast("timestamp")) % 3, F.coalesce("clock_skew_ms", F.lit(0)) % 4, F.lit(7).cast("bigint"))
    return table(spark, root, "peers").select("node", display.negotiate(offered).alias("version"))


@query("SELECT exit FROM (SELECT max(CASE severity WHEN 'warn' THEN 1 WHEN 'critical' THEN 2 ELSE 0 END) AS exit FROM (" + _SQL["health"] + "))")
def health_exit(spark: SparkSession, root: str) -> DataFrame:
    return reports.health_exit(reports.health(_records(spark, root), table(spark, root, "peers"), table(spark, root, "space_keys")))


# --- streams drained with availableNow and read back


def _stream_folder(spark: SparkSession, root: str) -> tuple[str, Scratch]:
    scratch = Scratch(spark, "stream")
    records = _records(spark, root).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4)))
    for k in range(4):
        chosen = records.where((F.col("part") == k) | (F.pmod(F.col("part") + 1, F.lit(4)) == k)).drop("part")  # every row comes twice
        scratch.write(chosen.coalesce(1), "source", mode="append")
    return scratch.at("source"), scratch


@query(f"SELECT DISTINCT space, {CANON.format('id')} AS id, kind FROM records")
def stream_ingest(spark: SparkSession, root: str) -> DataFrame:
    source, scratch = _stream_folder(spark, root)
    target = store.RecordStore(spark, scratch.at("store"))
    streaming.ingest(streaming.record_stream(spark, source, 2), target, scratch.at("checkpoint")).awaitTermination()
    return target.read().select("space", "id", "kind")


@query(_SQL["version_vector"])
def stream_version_vector(spark: SparkSession, root: str) -> DataFrame:
    source, scratch = _stream_folder(spark, root)
    out = scratch.at("vector")
    stream = streaming.vector_stream(streaming.record_stream(spark, source, 2))
    stream.writeStream.outputMode("complete").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/{k}")).option("checkpointLocation", scratch.at("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/*").groupBy("space", "node").agg(F.max("high").alias("high"))


_CLOCK = f"""WITH RECURSIVE e AS (SELECT author_node, hlc.wall AS w, hlc.counter AS c, epoch_us(received_at) // 1000 AS now, row_number() OVER (PARTITION BY author_node ORDER BY received_at, id) AS k FROM records),
f AS (SELECT author_node, 0::BIGINT AS k, 0::BIGINT AS wall, 0::BIGINT AS counter FROM (SELECT DISTINCT author_node FROM e) UNION ALL
 SELECT e.author_node, e.k, greatest(f.wall, w, now), CASE WHEN greatest(f.wall, w, now) = f.wall AND f.wall = w THEN greatest(f.counter, c) + 1 WHEN greatest(f.wall, w, now) = f.wall THEN f.counter + 1 WHEN greatest(f.wall, w, now) = w THEN c + 1 ELSE 0 END
 FROM f JOIN e ON e.author_node = f.author_node AND e.k = f.k + 1)
SELECT author_node, wall, counter FROM f QUALIFY row_number() OVER (PARTITION BY author_node ORDER BY k DESC) = 1"""


@query(_CLOCK)
def hlc_fold(spark: SparkSession, root: str) -> DataFrame:
    return clock.hlc_fold(_records(spark, root))


@query(_CLOCK.replace("SELECT author_node, wall", "SELECT author_node AS node, wall"))
def stream_clocks(spark: SparkSession, root: str) -> DataFrame:
    """The clocks after one drained micro-batch, each node's records in order of arrival."""
    scratch = Scratch(spark, "clocks")
    source, out = scratch.at("source"), scratch.at("out")
    _records(spark, root).coalesce(1).sortWithinPartitions("received_at", "id").write.parquet(source)
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        stream = streaming.clock_stream(streaming.record_stream(spark, source))
        stream.writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.mode("append").parquet(out)).option("checkpointLocation", scratch.at("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("node").agg(F.max(F.struct("wall", "counter")).alias("m")).select("node", "m.wall", "m.counter")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
