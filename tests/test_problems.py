"""Orphans, deliveries, hierarchies and change feeds, against brute force and in every awkward case."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemolake.operators.changefeed import current_entries
from mnemolake.operators.delivery_store import DeliveryStore, exactly_once, repeated_deliveries
from mnemolake.operators.hierarchy import contract, descendants, hierarchy
from mnemolake.operators.orphans import orphan_counts, orphan_references
from mnemolake.schema import RECORD
from mnemolake.session import setting


def ident(i):
    return f"01K4ZNE2F161394JJ04ZRK{i:04d}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- references


def test_orphan_kinds(make):
    r = make(
        [
            {"supersedes": [ident(90), ident(90).lower()]},  # missing, in two spellings
            {"refs": [ident(2)]},  # comes later
            {},
            {"kind": "tombstone", "supersedes": [ident(2)], "body": None},
            {"refs": [ident(2)]},  # after the tombstone
            {"refs": [ident(2)], "space": "user/u"},  # another space
        ]
    )
    got = {(a[-1], f, b[-2:], s) for a, f, b, s, d in rows(orphan_references(r))}
    assert got == {("0", "supersedes", "90", "missing"), ("1", "refs", "02", "late"), ("4", "refs", "02", "deleted"), ("5", "refs", "02", "missing")}


def test_a_tombstone_does_not_delete_its_own_target(make):
    one = make([{}, {"kind": "tombstone", "supersedes": [ident(0)]}])
    assert rows(orphan_references(one)) == []
    two = make([{}, {"kind": "tombstone", "supersedes": [ident(0)], "at": 5}, {"kind": "tombstone", "supersedes": [ident(0)], "at": 5}])
    assert {(a[-1], s) for a, _, _, s, _ in rows(orphan_references(two))} == {("1", "deleted"), ("2", "deleted")}


def test_orphan_edge_cases(make, spark):
    assert orphan_references(spark.createDataFrame([], RECORD)).count() == 0
    odd = make([{"id": None, "refs": [ident(7)]}, {"space": None, "refs": [None, "", ident(8)]}, {"at": None, "supersedes": [ident(0)]}, {"tags": None, "body": "x" * 100_000, "kind": None}])
    odd = odd.withColumn("key", F.lit(1)).withColumn("field", F.lit("x")).withColumn("status", F.lit("y"))  # clashing names
    got = {(f, t, s, d) for _, f, t, s, d in rows(orphan_references(odd))}
    assert got == {("refs", "", "missing", "2025-09-12"), ("refs", ident(8), "missing", "2025-09-12"), ("supersedes", ident(0), "missing", None)}
    assert rows(orphan_references(odd.union(odd))) == rows(orphan_references(odd))


def test_hot_target_is_salted_and_counted(make):
    hot = make([{"refs": [ident(9999)]} for _ in range(60)] + [{"refs": [ident(3)]}])
    plain, salted = rows(orphan_references(hot)), rows(orphan_references(hot, hot_rows=7))
    assert plain == salted and len(plain) == 60
    assert orphan_counts(orphan_references(hot)).first().n_refs == 60


# --- deliveries


def deliveries(spark, items):
    base = dt.datetime(2025, 9, 12)
    data = [(n, b, "p", None if t is None else base + dt.timedelta(seconds=t), "s", i, a, 0, b"x") for n, b, t, i, a in items]
    return spark.createDataFrame(data, "delivery_no bigint, batch_id string, from_node string, received_at timestamp_ntz, space string, id string, author_node string, epoch bigint, blob binary")


def test_repeated_deliveries(spark):
    d = deliveries(
        spark,
        [(1, "a", 5, "01KOIL", "n"), (2, "b", 5, "01k011", " n "), (3, "c", 4, "01K011", "n"), (4, None, None, "01K011", "n"), (5, "a", 1, "01K011", "m"), (6, "a", 1, None, "n"), (7, "a", 1, None, "n"), (8, "a", 1, "01K011", None)],
    ).withColumn("first", F.lit(0)).withColumn("msg_id", F.lit("clash"))
    assert sorted(r[0] for r in repeated_deliveries(d).collect()) == [1, 2, 4]
    assert sorted(r[0] for r in exactly_once(d).select("delivery_no").collect()) == [3, 5, 6, 7, 8]
    assert repeated_deliveries(d.limit(0)).count() == 0


def test_upsert_is_idempotent_and_runs_merge_in_order(spark):
    rnd = random.Random(4)
    d = deliveries(spark, [(k, f"b{k % 5}", rnd.randrange(50), f"01K{'A' if k % 3 == 0 else rnd.randrange(40)}", "n") for k in range(300)])
    once, twice = DeliveryStore(spark, 4), DeliveryStore(spark, 4)
    once.upsert(d)
    for part in (d.where("delivery_no % 2 = 0"), d, d.where("delivery_no % 2 = 1"), d):
        twice.upsert(part)
    with setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
        plan = twice.merged(*twice.runs[:2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert rows(once.compact()) == rows(twice.compact())
    assert len(twice.runs) == 1
    files = [p for p in twice.spark.table(twice.runs[0]).inputFiles()]
    assert len(files) <= 4
    for f in files:  # one sorted file a bucket
        got = [tuple(r) for r in spark.read.parquet(f).coalesce(1).select("msg_id", "msg_node").collect()]
        assert got == sorted(set(got))
    twice.upsert(d)  # a compacted store goes on
    assert rows(twice.close()) == rows(once.close())
    assert spark.sql("SHOW TABLES LIKE 'delivery_run*'").count() == 0


def test_a_null_delivery_number_is_never_dropped(spark):
    d = deliveries(spark, [(None, "a", 5, "01K011", "n"), (1, "a", 5, "01K011", "n"), (2, "a", 6, "01K011", "n")])
    assert sorted(r[0] for r in repeated_deliveries(d).collect()) == [1, 2]


# --- hierarchies


def brute(links):
    out = {}
    for n in set(links) | set(links.values()):
        seen, at = [], n
        while at in links and at not in seen:
            seen.append(at)
            at = links[at]
        out[n] = (min(seen[seen.index(at) :]), -1) if at in seen else (at, len(seen))
    return out


def forest(rnd, n):
    return {ident(i): ident(rnd.randrange(n) if rnd.random() < 0.1 else max(0, i - rnd.randrange(1, 4))) for i in range(n) if rnd.random() < 0.9}


@pytest.mark.parametrize("task_rows", [40, 10_000])
def test_hierarchy_equals_brute_force(make, task_rows):
    rnd = random.Random(task_rows)
    links = forest(rnd, 150)
    r = make([{"supersedes": [links[ident(i)].lower()] if ident(i) in links else None} for i in range(150)])
    got = {i: (root, depth) for i, root, depth in rows(hierarchy(r, task_rows=task_rows, hot_rows=20).select("id", "root_id", "depth"))}
    assert got == brute(links)


def test_circles_across_partitions_end(make):
    """Rings of odd, even and large length in random order of ids, some with a tail; every link leaves its partition."""
    rnd = random.Random(3)
    ids = [ident(i) for i in range(90)]
    rnd.shuffle(ids)
    links, at = {}, 0
    for length in (3, 3, 5, 6, 7, 2, 50):
        ring = ids[at : at + length]
        links |= dict(zip(ring, ring[1:] + ring[:1]))
        at += length
    links |= dict(zip(ids[at:], [ids[0], *ids[at:]]))  # a tail that leads into the first ring
    r = make([{"supersedes": [links[ident(i)]] if ident(i) in links else None} for i in range(90)])
    got = {i: (root, depth) for i, root, depth in rows(hierarchy(r, task_rows=8, hot_rows=9).select("id", "root_id", "depth"))}
    assert got == brute(links)


def test_paths_and_descendants(make):
    r = make([{}, {"supersedes": [ident(0)]}, {"supersedes": [ident(1), ident(0)]}, {"supersedes": [ident(3)]}, {"supersedes": [ident(3)]}])
    for task_rows in (2, 100):
        h = hierarchy(r, trails=True, task_rows=task_rows)
        got = {i[-1]: (depth, [p[-1] for p in path]) for _, i, _, depth, path in h.collect()}
        assert got == {"0": (0, ["0"]), "1": (1, ["0", "1"]), "2": (2, ["0", "1", "2"]), "3": (-1, []), "4": (-1, [])}
        assert {(a[-1], b[-1], n) for _, a, b, n in descendants(h).collect()} == {("0", "1", 1), ("0", "2", 2), ("1", "2", 1)}


def test_hierarchy_edge_cases(make, spark):
    assert hierarchy(spark.createDataFrame([], RECORD)).count() == 0
    odd = make([{"supersedes": ["", None, ident(50)]}, {"id": None, "supersedes": [ident(0)]}, {"space": None}, {"space": None, "supersedes": [ident(2), ident(0)]}]).withColumn("parent", F.lit("x")).withColumn("state", F.lit(1))
    assert rows(hierarchy(odd).select("space", "id", "root_id", "depth")) == [(None, ident(2), ident(2), 0), (None, ident(3), ident(2), 1)]


def test_contract_on_a_long_chain_and_a_ring():
    n = 5000
    pdf = pd.DataFrame({"space": "s", "id": [f"{i:05d}" for i in range(n)], "state": ["open"] * n, "anchor": [f"{i - 1:05d}" if i else "zz" for i in range(n)], "hops": 1, "low": [f"{i:05d}" for i in range(n)]})
    out = contract(pdf)
    assert (out["anchor"] == "zz").all() and out["hops"].max() == n and (out["state"] == "open").all()
    pdf.loc[0, "anchor"] = f"{n - 1:05d}"
    ring = contract(pdf)
    assert (ring["state"] == "circle").all() and (ring["anchor"] == "00000").all() and (ring["hops"] == -1).all()


# --- change feed


def feed(spark, items):
    data = [(k, dt.datetime(2025, 1, 1), s, i, "n", "a", None, None if w is None else {"wall": w, "counter": c}, 0, kind, "asserted", "m", None, sup, 1) for k, (s, i, w, c, kind, sup) in enumerate(items)]
    return spark.createDataFrame(data, "change_no bigint, arrived_at timestamp_ntz, space string, id string, author_node string, author_agent string, author_model string, hlc struct<wall:bigint,counter:bigint>, epoch bigint, kind string, evidence string, embed_model string, tags array<string>, supersedes array<string>, bytes bigint")


def test_change_feed_equals_brute_force(spark):
    rnd = random.Random(9)
    items = []
    for k in range(400):
        sup = [f"E{rnd.randrange(30)}" for _ in range(rnd.choice([0, 1, 1, 2]))] or rnd.choice([None, []])
        items.append((rnd.choice(["a", "b", None]), f"C{rnd.randrange(200)}", rnd.choice([None, *range(60)]), rnd.randrange(2), rnd.choice(["fact", "tombstone", "retraction", "episode"]), sup))
    best = {}
    for s, i, w, c, kind, sup in items:
        for e in set(sup or [i]):
            mark = (-1 if w is None else w, c if w is not None else -1, i, kind)
            best[s, e] = max(best.get((s, e), mark), mark)
    want = {(s, e, m[2]) for (s, e), m in best.items() if m[3] not in ("tombstone", "retraction")}
    for batches in (1, 3, 6):
        assert {tuple(r) for r in current_entries(feed(spark, items), batches=batches).collect()} == want


def test_base_rows_and_empty_feed(spark):
    base = spark.createDataFrame([("a", "E1", "B1"), ("a", "E2", "B2"), ("a", "E3", "B3")], "space string, entry_id string, current_id string")
    f = feed(spark, [("a", "C1", 5, 0, "fact", ["e1"]), ("a", "C2", 6, 0, "tombstone", ["E2"])])
    assert rows(current_entries(f, base)) == [("a", "E1", "C1"), ("a", "E3", "B3")]
    assert rows(current_entries(f.limit(0), base)) == rows(base)
    assert current_entries(f.limit(0)).count() == 0
