"""Behaviours of the store's own operators on literal rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemolake import schema
from mnemolake.engine import Engine
from mnemolake.functions import clock, display
from mnemolake.functions.embed import bucket, embed_texts, fnv1a, quantize, quantize_array
from mnemolake.functions.text import tokenize, tokens
from mnemolake.operators import catalog, recall, reports, spaces
from mnemolake.operators import version_vectors as vv
from mnemolake.operators.vector_index import pool, pooled_by_query, top_k, top_k_by_query
from mnemolake.operators.write import IdSource, Writer, ulid_value
from mnemolake.sources.store import RecordStore, folder_to_space, new_rows, range_scan, space_to_folder


def ident(i):
    return f"01K4ZNE2F161394JJ04ZRK{i:04d}"


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


CASES = [("parse_ts assumes UTC", ["parse_ts", "assumes", "utc"]), ("flake: timezone-assumption!", ["flake", "timezone", "assumption"]), ("a b crew", ["crew"]), ("go 1.24 error 500", ["go", "1", "24", "error", "500"]), ("héllo wörld", ["héllo", "wörld"]), ("", []), ("!!! ...", []), ("ä a", ["ä"])]


def test_tokenizers_agree(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "t string").select("t", tokens(F.col("t")).alias("w"))
    assert {r.t: r.w for r in df.collect()} == dict(CASES) == {t: tokenize(t) for t, _ in CASES}


def test_embedding_properties(spark):
    for refused in ("", "   ", "!!!", "a"):
        assert embed_texts([refused])[0] == []
    _, v = embed_texts(["the UTC clock drifts on replica nodes", "replica nodes drift from the UTC clock", "a recipe for bread", "word " * 8 + "crew", "word crew"])
    assert np.allclose((v.astype(float) ** 2).sum(axis=1), 1, atol=1e-5)
    assert v[0] @ v[1] > v[0] @ v[2]
    assert v[3] @ v[4] >= 0.5
    h = 0xCBF29CE484222325
    for b in b"hello":
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert int(fnv1a([b"hello", b"", b"hellohello"])[0]) == h
    assert spark.createDataFrame([("hello",)], "f string").select(bucket(F.col("f")).alias("b")).first().b.bucket == h % 384


def test_quantize_is_symmetric(spark):
    x = [2.0, -2.0, 0.5, -0.5, 0.0039370079, 1.0]
    got = spark.createDataFrame([(x,)], "v array<double>").select(quantize(F.col("v")).alias("q")).first().q
    assert got == quantize_array(np.array(x)).tolist() and got[:2] == [127, -127] and got[2] == -got[3] == 64


def test_top_k_geometry_and_ties(spark):
    vs = [(3, [0.0, 1.0]), (2, [0.7, 0.714]), (1, [0.98, 0.199]), (9, [0.98, 0.199]), (4, None), (5, [1.0])]
    df = spark.createDataFrame(vs, "id int, v array<float>")
    assert [r.id for r in top_k(df, "v", np.array([1, 0]), 4).collect()] == [1, 9, 2, 3]
    assert top_k(df, "v", np.array([1, 0]), 0).count() == 0


def test_every_query_is_searched(spark):
    rnd = np.random.default_rng(7)
    vecs = rnd.standard_normal((500, 32)).astype(np.float32)
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(500, None), (501, [1.0])], "id int, v array<float>")
    asked = df.where("id % 50 = 0")
    exact = vecs.astype(np.float64) @ vecs.astype(np.float64).T
    want = {(q, int(i)) for q in range(0, 500, 50) for i in np.argsort(-exact[q], kind="stable")[:8]}
    for block in (1_000, 3):
        got = {(r.query_id, r.id) for r in top_k_by_query(df, "v", asked, 8, block=block).collect()}
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    one = top_k(df, "v", vecs[100], 8).select("id").collect()
    assert {r.id for r in one} == {i for q, i in got if q == 100}
    assert pooled_by_query(df, "v", asked, 8).groupBy("query_id").count().where(F.col("count") != pool(8)).count() == 0
    assert top_k_by_query(df, "v", asked.limit(0), 8).count() == 0 and top_k_by_query(df, "v", asked, 0).count() == 0


def test_human_sizes_cover_every_record(make, tmp_path):
    import duckdb

    sizes = [0, 5, 1023, 1024, 1280, 1536, 3 << 20, 1 << 30, 5 << 40, 7 << 50, 3 << 60, None]
    r = make([{"bytes": n} for n in sizes]).select("id", "bytes")
    r.write.parquet(f"{tmp_path}/records.parquet")
    got = sorted(map(tuple, entry.queries()["human_sizes"](r.sparkSession, str(tmp_path)).collect()))
    assert [s for _, s in got] == ["0B", "5B", "1023B", "1.0KB", "1.2KB", "1.5KB", "3.0MB", "1.0GB", "5.0TB", "7.0PB", "3072.0PB", None]
    sql = entry.oracle_sql()["human_sizes"].replace("FROM records", f"FROM '{tmp_path}/records.parquet/*.parquet'")
    assert sorted(duckdb.sql(sql).fetchall()) == got


def test_validation_names_the_first_violation(make):
    bad = {"id": schema.ZERO_ID}, {"space": "other/x"}, {"space": "user/" + "x" * 200}, {"author_node": "a b"}, {"author_agent": ""}, {"kind": "dream"}, {"evidence": "rumour"}, {"tags": ["b", "a"]}, {"tags": [""]}, {"supersedes": [ident(9).lower()]}, {"kind": "tombstone"}, {"kind": "conflict", "refs": [ident(1)]}, {"refs": [schema.ZERO_ID]}, {"causal_ctx": {"n": schema.ZERO_ID}}
    df = make([*bad, {}])
    got = [r.v for r in df.select(schema.first_violation(df).alias("v")).collect()]
    assert got == ["zero id", "bad space", "bad space", "bad node", "zero agent", "bad kind", "bad evidence", "tags not sorted and unique", "bad tag", "self in supersedes", "nothing superseded", "conflict needs two refs", "zero id in refs", "bad causal context", None]


def test_labels(spark):
    df = spark.createDataFrame([("agent/a",), ("user/u",), ("shared/s",), ("nonsense",)], "s string")
    assert [r[0] for r in df.select(schema.policy("s")).collect()] == ["lww", "siblings-auto", "siblings-manual", "siblings-manual"]
    back = df.select(folder_to_space(space_to_folder(F.col("s"))).alias("b")).collect()
    assert [r.b for r in back] == ["agent/a", "user/u", "shared/s", None]
    n = spark.createDataFrame([(0,), (253,), (255,), (1_000,), (70_000,)], "n bigint").select(display.padded_length(F.col("n"))).collect()
    assert [r[0] for r in n] == [256, 256, 1024, 1024, 131072]
    d = spark.createDataFrame([(-1,), (59,), (61,), (3_700,), (90_000,)], "s bigint").select(display.human_duration(F.col("s"))).collect()
    assert [r[0] for r in d] == ["never", "59s", "1m1s", "1h1m", "1d1h"]
    b = spark.createDataFrame([(5,), (1536,), (3 << 20,)], "n bigint").select(display.human_bytes(F.col("n"))).collect()
    assert [r[0] for r in b] == ["5B", "1.5KB", "3.0MB"]
    key = bytes(range(32))
    k = spark.createDataFrame([(key,)], "k binary").select(display.agent_text(F.col("k")).alias("t")).withColumn("back", display.parse_key(F.col("t"))).first()
    assert k.t.startswith("ag_") and bytes(k.back) == key


def test_edges_and_liveness(make):
    early = make([{"kind": "retraction", "supersedes": [ident(1)], "body": "why"}])
    assert ids(catalog.pending_supersessions(early)) == [ident(1)]
    r = make([{"kind": "retraction", "supersedes": [ident(1)], "body": "why"}, {}, {"kind": "tombstone", "supersedes": [ident(0)]}])
    assert ids(catalog.live(r)) == [ident(2)]  # one hop: the withdrawn retraction still withdraws
    assert catalog.pending_supersessions(r).count() == 0
    assert catalog.retractions(r).first().reason == "why"
    assert ids(catalog.tombstoned(r)) == [ident(0)]
    assert {x.kind: x.n_live for x in catalog.counts_by_kind(r).collect()} == {"retraction": 0, "fact": 0, "tombstone": 1}


def test_siblings(make):
    r = make([{"causal_ctx": {"n1": ident(0)}}, {"causal_ctx": {"n1": ident(0)}}, {"kind": "conflict", "refs": [ident(0), ident(1)]}, {"kind": "tombstone", "supersedes": [ident(2)]}, {"kind": "conflict", "refs": [ident(0), ident(5), ident(6), ident(7), ident(8), ident(9)]}] + [{}] * 5)
    got = [(x.id[-1], x.sibling[-1], x.rn, x.more, x.saw_this_claim) for x in catalog.siblings(r).orderBy("id", "rn").collect() if x.id[-1] in "01"]
    assert got == [("0", "5", 1, 2, False), ("0", "6", 2, 2, False), ("0", "7", 3, 2, False), ("0", "8", 4, 2, False), ("1", "0", 1, 0, False)]
    assert [x.saw_this_claim for x in catalog.all_siblings(r).where(f"id = '{ident(0)}' AND sibling = '{ident(1)}'").collect()] == [True]


def test_range_scan_and_idempotent_append(make, spark, tmp_path):
    r = make([{} for _ in range(20)])
    assert ids(range_scan(r, "n1", ident(4), ident(9))) == [ident(i) for i in range(5, 10)]
    assert ids(range_scan(r, "n1", ident(4), ident(9), 3)) == [ident(5), ident(6), ident(7)]
    assert range_scan(r, "nobody", ident(4), ident(9)).count() == 0
    s = RecordStore(spark, str(tmp_path / "store"))
    assert [s.append(r).count() for _ in range(3)] == [20, 0, 0]
    assert new_rows(s.read(), make([{"body": "other"}])).count() == 0  # the first write of an id wins
    with pytest.raises(ValueError, match="rejected"):
        s.accept(make([{"id": ident(77)}, {"id": ident(78), "kind": "dream"}]))
    assert s.read().count() == 20


vectors = st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz")), st.integers(0, 9), max_size=6)


@settings(max_examples=5, deadline=None)
@given(vectors, vectors)
def test_vector_lattice_laws(spark, a, b):
    frame = lambda d: spark.createDataFrame([(s, n, str(h)) for (s, n), h in d.items()], "space string, node string, high string")
    x, y = frame(a), frame(b)
    as_set = lambda d: {tuple(r) for r in d.collect()}
    assert as_set(vv.merge(x, y)) == as_set(vv.merge(y, x))
    assert as_set(vv.merge(x, x)) == as_set(x)
    assert all(r.b_dominates for r in vv.compare(x, vv.merge(x, y)).collect())
    assert vv.missing_ranges(vv.merge(x, y), y).count() == 0


def test_marks_leave_holes_but_exact_reconciliation_does_not(make):
    peer = make([{} for _ in range(10)])
    local = peer.where(F.col("id") == ident(9))  # the last one came first
    assert vv.delta(peer, vv.missing_ranges(vv.version_vector(local), vv.version_vector(peer))).count() == 0
    assert vv.set_missing(local, peer).count() == 9


def test_exchanges_converge(make):
    rnd = random.Random(2)
    every = make([{"author_node": f"n{i % 3}", "space": rnd.choice(["user/a", "user/b"])} for i in range(30)])
    a, b = every.where("author_node <> 'n0'"), every.where("author_node <> 'n1'")
    ab, ba = vv.exchange(a, b), vv.exchange(b, a, batch=4)
    assert ids(ab) == ids(ba) == ids(every)
    assert vv.lag(vv.version_vector(ab), vv.version_vector(ba)).first() == (0, 0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=12))
def test_clock_fold_equals_stepwise(spark, events):
    base = 1_757_700_000_000
    data = [("n", f"{i:03d}", {"wall": base + w, "counter": c}, base + now) for i, (now, w, c) in enumerate(events)]
    df = spark.createDataFrame(data, "author_node string, id string, hlc struct<wall:bigint,counter:bigint>, ms bigint")
    # local time does not go back in an ordered feed
    df = df.withColumn("received_at", F.timestamp_millis(F.max("ms").over(__import__("pyspark").sql.Window.orderBy("id"))))
    last, top = (0, 0), 0
    for _, _, h, ms in data:
        top = max(top, ms)
        last = clock.advance(last, (h["wall"], h["counter"]), top)
    r = clock.hlc_fold(df).first()
    assert (r.wall, r.counter) == last


def test_ids_never_go_back():
    s = IdSource()
    got = [s.next(m) for m in (5, 5, 4, 6, 6)]
    assert got == sorted(got) and len(set(got)) == 5 and ulid_value(got[-1]) >> 80 == 6
    s.last = (1 << 80) * 7 - 1
    with pytest.raises(OverflowError):
        s.next(1)
    with pytest.raises(ValueError):
        Writer("n", "a").record("user/u", "  ")


def test_keys_and_seals(make, spark):
    keys = spark.createDataFrame([("user/u", 0, True)], "space string, epoch bigint, is_current boolean")
    turned = spaces.rotate(keys, "user/u")
    assert sorted((r.epoch, r.is_current) for r in turned.collect()) == [(0, False), (1, True)]
    assert sorted((r.space, r.epoch) for r in spaces.rotate(keys, "user/v").collect()) == [("user/u", 0), ("user/v", 0)]
    r = make([{"space": "user/u"}, {"space": "user/u", "epoch": 3}, {"space": "user/x", "epoch": 3}])
    assert [tuple(x) for x in spaces.undecryptable(r, keys).collect()] == [("user/u", 1)]
    key, aad = F.lit("k" * 32).cast("binary"), spaces.record_aad(F.col("space"), F.col("id"), F.col("author_node"), F.col("epoch"))
    sealed = r.withColumn("blob", spaces.seal(F.col("body").cast("binary"), key, aad))
    assert [bytes(x[0]) for x in sealed.select(spaces.open_sealed(F.col("blob"), key, aad)).collect()] == [b"b"] * 3
    assert [x[0] for x in sealed.select(spaces.open_sealed(F.col("blob"), key, F.lit(b"other").cast("binary"))).collect()] == [None] * 3


def test_health_rules(make, spark):
    peers = spark.sql("""SELECT * FROM VALUES ('p1', true, 'a', 'direct', 's', 'other', TIMESTAMP_NTZ'2026-01-01 00:00:00', 2500L, array(''), TIMESTAMP_NTZ'2026-01-01 00:12:00'), ('n1', true, 'a', 'direct', 's', 'hashbag-v1-384', NULL, -2500L, array(''), TIMESTAMP_NTZ'2026-01-01 00:12:00')
        AS t(node, enrolled, address, transport, software, embed_model, last_contact, clock_skew_ms, agent_keys, as_of)""")
    keys = spark.createDataFrame([("shared/s", 0, True)], "space string, epoch bigint, is_current boolean")
    got = {r.check: r.severity for r in reports.health(make([{}, {"space": "user/x"}]), peers, keys, queued=1500).collect()}
    assert got == {"daemon": "ok", "store": "ok", "index": "ok", "torn-tail": "ok", "clock-skew": "warn", "embed-model": "warn", "key-epoch": "ok", "unsendable": "warn", "outbound-queue": "warn", "peer-reachability": "warn", "participants": "warn", "conflict-backlog": "ok"}
    assert reports.clock_skew(peers).first().worst_node == "n1"
    assert reports.clock_skew(peers.limit(0)).first().severity == "skipped"


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), "n1", "ag_me")
    with pytest.raises(ValueError):
        e.remember("user/u", "no key yet")
    e.create_space("user/u")
    a = e.remember("user/u", "parse_ts assumes UTC in the importer", kind="fact", tags=["tz"])
    b = e.remember("user/u", "the importer assumes local time, not UTC", kind="fact")
    e._write(e.writer.conflict("user/u", [a, b], epoch=0))
    hits = {r.id: r for r in e.recall("does the importer assume UTC").collect()}
    assert hits[a].siblings[0].sibling == b and hits[b].siblings[0].saw_this_claim is False and hits[a].siblings[0].saw_this_claim is True
    assert ids(e.recall("importer UTC", tags=["tz"])) == [a] and e.recall("importer UTC", tags=["tz", "missing"]).count() == 0
    gone = e.forget("user/u", a, "it reads the zone from the file")
    assert a not in ids(e.recall("parse_ts assumes UTC in the importer"))
    again = e.recall("parse_ts assumes UTC in the importer", include_superseded=True).where(F.col("id") == a).first()
    assert again.retractions == ["it reads the zone from the file"] and again.superseded_by == [gone]
    assert e.get("user/u", a).first().superseded
    with pytest.raises(KeyError):
        e.link("user/u", [a, ident(5)])
    other = Engine(spark, str(tmp_path / "db2"), "n2", "ag_you")
    assert other.sync(e.store) == 4 and other.sync(e.store) == 0
    assert e.list_spaces().first().records == 4
    with pytest.raises(ValueError):
        recall.query_vector("!!")
