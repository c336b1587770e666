"""The kept index, the store's appends and files, padding, carried spaces, and nodes that exchange over cut links."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.engine import Engine
from mnemolake.functions import display
from mnemolake.operators import version_vectors as vv
from mnemolake.operators.vector_index import VectorIndex, build_index
from mnemolake.sources.store import RecordStore
from mnemolake.streaming.mesh import Mesh


def ident(i):
    return f"01K4ZNE2F161394JJ04ZRK{i:04d}"


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_index_is_kept_replaced_and_warmed(make, spark, tmp_path):
    r = make([{"body": f"note number {i} about replicas", "space": f"user/{'ab'[i % 2]}"} for i in range(12)] + [{"kind": "tombstone", "supersedes": [ident(0)]}, {"body": "!!!", "tags": None}])
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.cold(r) and index.read().count() == 0
    index.warm(r.limit(5))
    assert index.cold(r)
    index.warm(r)
    assert not index.cold(r) and index.totals().first().vectors == 12
    found = index.search(np.eye(1, 384, dtype=np.float32)[0], 3).collect()
    assert len(found) == 6 and {x.space for x in found} == {"user/a", "user/b"}
    plan = spark.read.schema(VectorIndex.SCHEMA).parquet(index.path).select("space", "id", "q8")._jdf.queryExecution().executedPlan().toString()
    assert "vec" not in plan.split("ReadSchema")[1]
    other = make([{"body": "quite another text", "space": "user/a"}])
    index.add(build_index(other))  # the same id again: the last write wins
    assert index.totals().first().vectors == 12 and index.has("user/a", ident(0).lower())
    kept = {x.id: list(x.vec) for x in index.read().where("space = 'user/a'").collect()}
    assert kept[ident(0)] == list(build_index(other).first().vec)
    index.remove(spark.createDataFrame([("user/a", ident(0))], "space string, id string"))
    assert not index.has("user/a", ident(0)) and index.totals().first().vectors == 11
    index.remove(index.read().where("space = 'user/b'").select("space", "id"))
    assert {x.space for x in index.read().collect()} == {"user/a"}


def test_store_appends_canonical_rows_and_compacts(make, spark, tmp_path):
    s = RecordStore(spark, str(tmp_path / "store"))
    r = make([{"space": f"user/{'ab'[i % 2]}", "id": ident(i).lower()} for i in range(12)])
    for k in range(3):
        got = s.append(r.where(f"hlc.counter = 0 AND hlc.wall % 3 = {k}"))
        assert ids(got) == ids(got)  # written, so the same however often it is read
    assert s.append(r).count() == 0 and ids(s.read()) == [ident(i) for i in range(12)]
    assert {x.segments for x in s.segments().collect()} == {3}
    assert s.compact(most_files=1) == ["user/a", "user/b"] and {x.segments for x in s.segments().collect()} == {1}
    assert ids(s.read()) == [ident(i) for i in range(12)] and s.compact(most_files=1) == []


def test_padding_is_exact(spark):
    data = [b"", b"a", b"x" * 253, b"x" * 254, b"y" * 1000, b"z" * 70_000, None]
    df = spark.createDataFrame([(d,) for d in data], "d binary").withColumn("p", display.pad(F.col("d"))).withColumn("u", display.unpad(F.col("p")))
    for r in df.collect():
        assert r.u == r.d and (r.d is None or len(r.p) in (256, 1024, 131072))
    good = bytes([0, 1]) + b"a" + bytes(253)
    bad = [good[:-1], good + b"\0", good[:-1] + b"\1", b"\1" + good[1:], bytes([0, 0x81, 0]) + b"a" + bytes(252), bytes([0, 200]), b"", bytes([0] + [255] * 255)]
    got = spark.createDataFrame([(x,) for x in (good, *bad)], "p binary").select(display.unpad(F.col("p"))).collect()
    assert [x[0] for x in got] == [b"a"] + [None] * len(bad)


def test_fingerprint_and_kinds(spark):
    r = spark.createDataFrame([("ag_aaaqeayeaudaocajbifqydiob4dypq", {"fact": 2, "episode": 0, "conflict": 1}, {})], "a string, k map<string,int>, e map<string,int>")
    assert r.select(display.fingerprint(F.col("a")), display.kind_list(F.col("k")), display.kind_list(F.col("e"))).first() == ("aaaqeaye…dypq", "conflict:1 fact:2", "-")


def test_bounded_pull_takes_every_space_along(make):
    peer = make([{"space": f"user/{'ab'[i % 2]}"} for i in range(20)])
    assert ids(vv.exchange(peer.limit(0), peer, rounds=2, batch=5)) == ids(peer)
    assert vv.exchange(peer.limit(0), peer, rounds=1, batch=5).count() == 10


def test_mesh_queues_pushes_and_converges(make, spark, tmp_path):
    rnd = random.Random(4)
    mesh = Mesh(spark, {n: RecordStore(spark, str(tmp_path / n)) for n in "abc"}, batch=2)
    mesh.cut("a", "b"), mesh.cut("a", "c")
    assert mesh.write("a", make([{"author_node": "a", "space": f"user/{k % 2}", "id": ident(k)} for k in range(6)])) == 6
    assert mesh.push("a") == [] and mesh.queued("a") == 6  # nobody online: the queue stays
    assert {r.peer: r.error for r in mesh.sync_now("a").collect()} == {"b": "offline", "c": "offline"}
    mesh.write("b", make([{"author_node": "b", "space": "user/0", "id": ident(50 + k)} for k in range(3)]))
    mesh.heal("a", "c")
    report = {r.peer: (r.pulled, r.error) for r in mesh.sync_now("a").collect()}
    assert report == {"b": (0, "offline"), "c": (0, None)} and mesh.queued("a") == 0 and mesh.stores["c"].read().count() == 6
    with pytest.raises(KeyError):
        mesh.sync_now("a", only="nobody")
    one = mesh.sync_now("b", only="c", space="user/1").collect()
    assert [(r.peer, r.pulled) for r in one] == [("c", 3)] and mesh.stores["b"].read().count() == 6
    mesh.heal()
    nodes = list("abcab")
    rnd.shuffle(nodes)
    for n in [*nodes, *"abc"]:
        for p in mesh.online(n):
            mesh.pull(n, p)
    marks = [{tuple(r) for r in vv.version_vector(mesh.stores[n].read()).collect()} for n in "abc"]
    assert marks[0] == marks[1] == marks[2] and [mesh.stores[n].read().count() for n in "abc"] == [9, 9, 9]
    assert mesh.lag("a").where("lag_behind > 0").count() == 0


def test_engine_spaces_index_and_notes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), "n1", "ag_me")
    e.create_space("user/u")
    a = e.remember("user/u", "parse_ts assumes UTC in the importer", kind="fact")
    assert e.index.has("user/u", a) and e.get("user/u", a.lower()).first().score == 1
    hits, notes, skipped = e.recall_notes("importer UTC", spaces=["user/u", "user/x"])
    assert ids(hits) == [a] and notes.count() == 0 and [tuple(r) for r in skipped.collect()] == [("user/x", "not held")]
    e.forget("user/u", a.lower())
    assert e.recall("importer UTC").count() == 0
    late = RecordStore(spark, str(tmp_path / "db"))
    late.append(e.records.limit(1).withColumn("id", F.lit(ident(1))).withColumn("kind", F.lit("fact")).withColumn("body", F.lit("written behind the index")))
    again = Engine(spark, str(tmp_path / "db"), "n1", "ag_me", keys=e.keys)
    assert not again.warm and again.recall_notes("importer")[1].count() == 1 and {r.check: r.severity for r in again.health().collect()}["index"] == "warn"
    again.warm_up()
    assert again.warm and ident(1) in ids(again.recall("written behind the index"))
    # a carried space: entries are taken unread, then its keys arrive
    entry = spark.createDataFrame([("shared/s", ident(5), "n2", 0, b"x", None)], "space string, id string, author_node string, epoch bigint, blob binary, received_at timestamp_ntz")
    with pytest.raises(ValueError, match="not carried"):
        e.accept_sealed(entry)
    e.relay_space("shared/s")
    assert [e.accept_sealed(entry), e.accept_sealed(entry)] == [1, 0] and e.store.sealed().count() == 1
    with pytest.raises(ValueError, match="readable"):
        e.relay_space("user/u")
    other = Engine(spark, str(tmp_path / "db2"), "n2", "ag_you")
    e.rotate_space("user/u")
    other.join_space("user/u", e.share_space("user/u"))
    assert sorted((r.epoch, r.is_current) for r in other.keys.collect()) == [(0, False), (1, True)]
    other.save_keys(str(tmp_path / "keys"))
    e.load_keys(str(tmp_path / "keys"))
    assert e.keys.count() == 2
