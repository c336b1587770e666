"""Reports: members, clock skew, status, and the health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.embed import DIMS, MODEL
from mnemolake.operators import catalog
from mnemolake.operators.spaces import readable, relayed, undecryptable
from mnemolake.schema import UNINDEXED_KINDS

# Thresholds.
SKEW_WARN_MS, SKEW_CRITICAL_MS = 2_000, 30_000
SILENT_WARN_S, SILENT_CRITICAL_S = 600, 3_600
QUEUE_WARN, QUEUE_CRITICAL = 1_000, 10_000
CONFLICTS_WARN = 20
RAM_BUDGET = 512 * 1024 * 1024
EXIT = {"ok": 0, "skipped": 0, "warn": 1, "critical": 2}
CHECKS = ("daemon", "store", "index", "torn-tail", "clock-skew", "embed-model", "key-epoch", "unsendable", "outbound-queue", "peer-reachability", "participants", "conflict-backlog")
REMEDIES = {
    "daemon": "make the data folder writable", "index": "let the index warm up, or rebuild it", "torn-tail": "look for power loss or killed writers", "clock-skew": "run a time service on the peer",
    "embed-model": "agree on one embedding model, then re-embed", "key-epoch": "ask the owner to share the space again", "unsendable": "turn relaying on, or drop the space", "outbound-queue": "find out why peers do not keep up",
    "peer-reachability": "check the network to the silent peers", "participants": "check that idle peers hold a common space and its key", "conflict-backlog": "resolve open conflicts",
}


def exit_code(severity: Column) -> Column:
    out = F.lit(0)
    for name, code in EXIT.items():
        out = F.when(severity == name, code).otherwise(out)
    return out


def members(records: DataFrame, peers: DataFrame, me: str | None = None) -> DataFrame:
    """node, enrolled, participating, contact and skew: who is known, who has written, and who is in both."""
    wrote = records.where(F.col("author_node").isNotNull() & (F.col("author_node") != (me or ""))).select(F.col("author_node").alias("node")).distinct().withColumn("participating", F.lit(True))
    age = F.floor((F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("last_contact").cast("timestamp"))) / 1_000_000)
    known = peers.select("node", "enrolled", "address", "transport", "software", "embed_model", "clock_skew_ms", F.when(F.col("last_contact").isNull(), -1).otherwise(age).cast("bigint").alias("contact_age_s"))
    return known.join(wrote, "node", "full").select("node", F.coalesce("enrolled", F.lit(False)).alias("enrolled"), F.coalesce("participating", F.lit(False)).alias("participating"), "address", "transport", "software", "embed_model", F.coalesce("clock_skew_ms", F.lit(0)).alias("clock_skew_ms"), F.coalesce("contact_age_s", F.lit(-1)).alias("contact_age_s"))


def clock_skew(peers: DataFrame) -> DataFrame:
    """Worst absolute skew and its peer, the first in node order on ties; no peer where all are zero."""
    worst = peers.agg(F.min(F.struct((-F.abs(F.coalesce("clock_skew_ms", F.lit(0)))).alias("neg"), "node")).alias("w"))
    ms = -F.coalesce(F.col("w.neg"), F.lit(0))
    return worst.select(ms.alias("worst_ms"), F.when(ms > 0, F.col("w.node")).otherwise("").alias("worst_node"), F.when(F.col("w").isNull(), "skipped").when(ms >= SKEW_CRITICAL_MS, "critical").when(ms >= SKEW_WARN_MS, "warn").otherwise("ok").alias("severity"))


def _check(df: DataFrame, name: str, severity: Column, value: Column) -> DataFrame:
    return df.select(F.lit(CHECKS.index(name)).alias("position"), F.lit(name).alias("check"), severity.alias("severity"), value.cast("bigint").alias("value"))


def _over(value: Column, warn: int, critical: int | None = None) -> Column:
    out = F.when(value >= critical, "critical") if critical is not None else F.when(F.lit(False), "")
    return out.when(value >= warn, "warn").otherwise("ok")


def health(records: DataFrame, peers: DataFrame, keys: DataFrame, index: DataFrame | None = None, queued: int = 0, relaying: bool = False, model: str = MODEL, warm: bool = True, writable: bool = True, budget: int = RAM_BUDGET) -> DataFrame:
    """Twelve checks in fixed order: position, check, severity, value. What cannot run is skipped, never ok.

    Without an index table its population counts as every indexable record, superseded ones included,
    which the check compares with the live ones only.
    """
    one = lambda n: F.lit(n)
    live = catalog.with_liveness(records, ["kind"])
    indexable = ~F.col("kind").isin(*UNINDEXED_KINDS)
    counted = live.agg(F.count("*").alias("n"), F.count_if(indexable & F.col("live")).alias("indexable"), F.count_if(indexable).alias("vectors"), F.count_if((F.col("kind") == "conflict") & F.col("live")).alias("conflicts"))
    if index is not None:
        counted = counted.drop("vectors").withColumn("vectors", index.agg(F.count("*")).scalar())
    resident = F.col("vectors") * (DIMS + 40)
    index_state = (
        F.when(F.lit(not warm), "warn").when((F.col("indexable") > 0) & (F.col("vectors") == 0), "critical").when(F.col("vectors") < F.floor(F.col("indexable") * 9 / 10), "warn").when(resident > budget, "warn").otherwise("ok")
    )
    single = records.sparkSession.range(1)
    skew = clock_skew(peers)
    foreign = peers.agg(F.count_if(F.col("embed_model").isNotNull() & (F.col("embed_model") != "") & (F.col("embed_model") != model)).alias("peers"))
    stale = catalog.embed_models(records).agg(F.count_if(F.col("embed_model").isNotNull() & (F.col("embed_model") != "") & (F.col("embed_model") != model)).alias("held"))
    models = foreign.select("peers", stale.scalar().alias("held"))
    lost = undecryptable(records, keys).agg(F.coalesce(F.sum("n_undecryptable"), F.lit(0)).alias("n"))
    stuck = records.join(relayed(records, keys), "space", "left_semi").agg(F.count("*").alias("n")) if not relaying else single.select(F.lit(0).alias("n"))
    seen = members(records, peers)
    silent = peers.select(F.when(F.col("last_contact").isNull(), 1).when((age := F.floor((F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("last_contact").cast("timestamp"))) / 1_000_000)) >= SILENT_CRITICAL_S, 2).when(age >= SILENT_WARN_S, 1).otherwise(0).alias("level")).agg(F.max("level").alias("level"), F.count_if(F.col("level") > 0).alias("n"))
    idle = seen.agg(F.count_if("enrolled").alias("enrolled"), F.count_if(F.col("enrolled") & ~F.col("participating")).alias("idle"))
    parts = [
        _check(single, "daemon", one("ok" if writable else "critical"), one(0)),
        _check(counted, "store", one("ok"), F.col("n")),
        _check(counted, "index", index_state, F.col("vectors")),
        _check(single, "torn-tail", one("ok"), one(0)),
        _check(skew, "clock-skew", F.col("severity"), F.col("worst_ms")),
        _check(models, "embed-model", F.when((F.col("peers") > 0) | (F.col("held") > 0), "warn").otherwise("ok"), F.when(F.col("peers") > 0, F.col("peers")).otherwise(F.col("held"))),
        _check(lost, "key-epoch", F.when(F.col("n") > 0, "warn").otherwise("ok"), F.col("n")),
        _check(stuck, "unsendable", F.when(F.col("n") > 0, "warn").otherwise("ok"), F.col("n")),
        _check(single, "outbound-queue", _over(F.lit(queued), QUEUE_WARN, QUEUE_CRITICAL), F.lit(queued)),
        _check(silent, "peer-reachability", F.when(F.col("level").isNull(), "skipped").when(F.col("level") == 2, "critical").when(F.col("level") == 1, "warn").otherwise("ok"), F.col("n")),
        _check(idle, "participants", F.when(F.col("enrolled") == 0, "skipped").when(F.col("idle") > 0, "warn").otherwise("ok"), F.col("idle")),
        _check(counted, "conflict-backlog", _over(F.col("conflicts"), CONFLICTS_WARN), F.col("conflicts")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health_exit(checks: DataFrame) -> DataFrame:
    return checks.agg(F.max(exit_code(F.col("severity"))).alias("exit"))


def doctor(checks: DataFrame) -> DataFrame:
    """Checks that are not ok, each with what to do about it."""
    remedy = F.lit("")
    for name, text in REMEDIES.items():
        remedy = F.when(F.col("check") == name, text).otherwise(remedy)
    return checks.where(~F.col("severity").isin("ok", "skipped")).withColumn("remedy", remedy)


def status(records: DataFrame, peers: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: spaces, readable and relayed ones, records, bytes, agents, peers enrolled and participating."""
    base = records.agg(F.count_distinct("space").alias("spaces"), F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.count_distinct("author_agent").alias("agents"))
    who = members(records, peers).agg(F.count_if("enrolled").alias("e"), F.count_if("participating").alias("p"))
    return base.select("*", readable(records, keys).agg(F.count("*")).scalar().alias("readable"), relayed(records, keys).agg(F.count("*")).scalar().alias("relayed"), who.select("e").scalar().alias("enrolled"), who.select("p").scalar().alias("participating"))


def agent_records(agent_names: DataFrame, records: DataFrame) -> DataFrame:
    """name, key, n: every named agent with its record count, 0 where it wrote none."""
    return agent_names.join(catalog.agents(records).withColumnRenamed("author_agent", "key"), "key", "left").select("name", "key", F.coalesce("n", F.lit(0)).alias("n"))


def known_peers(discovered: DataFrame, remembered: DataFrame) -> DataFrame:
    """node, address: a remembered address wins where it is not empty."""
    both = discovered.select("node", F.col("address").alias("found")).join(remembered.select("node", F.col("address").alias("kept")), "node", "full")
    return both.select("node", F.coalesce(F.nullif("kept", F.lit("")), "found").alias("address"))


def discovered_peers(hosts: DataFrame, tag: str) -> DataFrame:
    """Hosts with the tag and an address, as peers in node order; direct where a current address is known."""
    from mnemolake.functions.display import node_name

    kept = hosts.where(F.array_contains("tags", tag) & (F.size("ips") > 0))
    return kept.select(node_name(F.col("hostname"), F.col("dns_name")).alias("node"), F.element_at("ips", 1).alias("address"), F.when(F.coalesce("cur_addr", F.lit("")) != "", "direct").otherwise("derp").alias("transport"), "online").orderBy("node")


def pick_peers(peers: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    return peers.orderBy(F.rand(seed)).limit(k)
