"""Corpus operators against brute force, exact round trips, and in every awkward case."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.functions.text import tokenize
from mnemolake.llm import cooccurrence, leakage, mojibake, near_dup, packing
from mnemolake.llm.components import components
from mnemolake.schema import RECORD

WORDS = [f"w{k}x{k * 7 % 13}" for k in range(4000)]


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(rnd, body, n):
    words = body.split()
    for _ in range(n):
        k = rnd.randrange(len(words))
        words[k : k + 1] = rnd.choice([[], [rnd.choice(WORDS)], [words[k], rnd.choice(WORDS)]])
    rnd.shuffle(words)
    return " ".join(words)


# --- near-duplicates


def brute_pairs(rows, threshold=0.7):
    sets = {}
    for i, (body, tags) in enumerate(rows):
        words = set(tokenize(body or ""))
        if len(words) >= 8:
            sets[i] = words | {w for t in tags or [] if t for w in tokenize(t)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def found_pairs(df, **more):
    return {(int(r.id_a[-4:]), int(r.id_b[-4:])) for r in near_dup.near_duplicate_pairs(df, **more).collect()}


@pytest.mark.parametrize("more", [{}, {"block": 3, "held_rows": 500, "members": 2, "part_rows": 2_000}])
def test_near_duplicates_equal_brute_force(make, more):
    rnd = random.Random(5)
    rows = []
    for _ in range(30):
        body = text(rnd, rnd.randrange(12, 60))
        rows.append((body, [rnd.choice(WORDS)]))
        rows += [(edited(rnd, body, rnd.randrange(5)), rnd.choice([None, [], [rnd.choice(WORDS), None, " "]])) for _ in range(rnd.randrange(4))]
    rows += [(text(random.Random(1), 40), None)] * 6  # exact copies
    want = brute_pairs(rows)
    df = make([{"body": b, "tags": t} for b, t in rows])
    got = found_pairs(df, **more)
    assert got <= want and len(want - got) <= 0.02 * len(want)
    near, groups = {i: {i} for i, (b, _) in enumerate(rows) if len(set(tokenize(b))) >= 8}, {}
    for a, b in got:
        near[a].add(b), near[b].add(a)
    for i in near:  # the smallest record that can be reached
        seen, todo = {i}, [i]
        while todo:
            todo += new if (new := near[todo.pop()] - seen) and not seen.update(new) else []
        groups[i] = (min(seen), len(seen), len(near[i]) - 1)
    more.pop("members", None)
    told = near_dup.near_duplicate_groups(df, hot_rows=3, **more).collect()
    assert {int(r.id[-4:]): (int(r.group_id[-4:]), r.group_size, r.n_links) for r in told} == groups


def test_variants_match_where_one_position_differs():
    sig = np.random.default_rng(1).integers(0, 1 << 32, (1, 14), dtype=np.uint32)
    near, far = sig.copy(), sig.copy()
    near[0, 3] += 1
    near[0, 7:] += 5
    far[0, ::3] += 1
    key = lambda s: set(near_dup.variants(s, 2, 7)[0].tolist())
    assert len(key(sig)) == 14 and key(sig) & key(near) and not key(sig) & key(far)


def test_sketches_lose_less_than_a_thousandth():
    below = lambda n, p, k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))
    assert below(near_dup.SHORT_BITS, 0.85, near_dup.SHORT_AGREE) + below(near_dup.SKETCH, 0.775, near_dup.SKETCH_AGREE) < 0.001


def test_near_duplicate_edge_cases(make, spark):
    assert near_dup.near_duplicate_pairs(spark.createDataFrame([], RECORD)).count() == 0
    body = "one two three four five six seven eight nine"
    odd = make([{"body": None}, {"body": ""}, {"body": "one two three"}, {"body": body, "tags": [None]}, {"body": body.upper(), "tags": []}, {"id": None, "body": body}, {"body": "tail " * 30_000 + body}])
    odd = odd.withColumn("set_id", F.lit("x")).withColumn("key", F.lit(1))
    assert found_pairs(odd.union(odd)) == {(3, 4), (3, 6), (4, 6)}
    got = {r.id[-4:]: (r.group_id[-4:], r.group_size, r.n_links) for r in near_dup.near_duplicate_groups(odd.union(odd)).collect()}
    assert got == {"0003": ("0003", 3, 2), "0004": ("0003", 3, 2), "0006": ("0003", 3, 2)}
    assert near_dup.near_duplicate_groups(odd.limit(0)).count() == 0


def test_packed_variants_come_back():
    rnd = np.random.default_rng(2)
    ids, size, short = rnd.integers(0, 1 << 62, 50), rnd.integers(8, 99, 50).astype(np.uint16), rnd.integers(0, 1 << 32, 50).astype(np.uint32)
    keys = rnd.integers(0, 1 << 63, (50, 6)).astype(np.uint64)
    got = {(part, *map(int, row)) for part, blob in near_dup._packed(ids, size, short, keys, 5) for row in zip(*near_dup._unpacked(blob))}
    assert got == {(int(k >> np.uint64(32)) % 5, int(k & np.uint64(0xFFFFFFFF)), int(ids[i]), int(short[i]), int(size[i])) for i in range(50) for k in keys[i]}


def test_components_of_long_chains(spark):
    links = [(k + 1, k) for k in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), hot_rows=5).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100} | {200 + k: 200 for k in range(30)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- co-occurrence


@pytest.mark.parametrize("chunk", [2, 3, 32])
def test_pairs_equal_brute_force_for_any_chunk(make, chunk):
    rnd = random.Random(chunk)
    tags = [f"t{k}" for k in range(14)]
    rows = [[rnd.choice(tags) for _ in range(rnd.choice([0, 1, 2, 5, 12]))] for _ in range(120)]
    rows += [["T1 ", " t2", "t1", "", "  ", None]] * 5 + [None]
    clean = [sorted({t.strip().lower() for t in r or [] if t and t.strip()}) for r in rows]
    n = sum(map(bool, clean))
    single = {t: sum(t in c for c in clean) for t in tags}
    pair = {(a, b): sum(a in c and b in c for c in clean) for a, b in itertools.combinations(sorted(tags), 2)}
    want = {(a, b, k, round(k * n / single[a] / single[b], 9)) for (a, b), k in pair.items() if k >= 3 and k * n / single[a] / single[b] >= 1.2}
    df = make([{"tags": r} for r in rows]).withColumn("items", F.lit(1)).withColumn("n", F.lit(2))
    got = cooccurrence.associated_tags(df, least=3, lift=1.2, chunk=chunk).collect()
    assert {(r.tag_a, r.tag_b, r.n_ab, round(r.lift, 9)) for r in got} == want


def test_no_tags_at_all(make, spark):
    assert cooccurrence.associated_tags(spark.createDataFrame([], RECORD)).count() == 0
    assert cooccurrence.associated_tags(make([{"tags": None}, {"tags": []}, {"tags": [None, ""]}]), least=1, lift=0).count() == 0


# --- packing


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_pack_keeps_all_limits():
    rnd = np.random.default_rng(3)
    tokens = rnd.integers(1, 900, 3000)
    loss = (tokens * rnd.random(3000)).astype(int)
    limits = packing.Limits(2048, 6, 1024)
    box = packing.pack(tokens, loss, limits)
    assert (box >= 0).all()
    for weight, cap in ((tokens, 2048), (np.ones(3000, int), 6), (loss, 1024)):
        assert np.bincount(box, weights=weight).max() <= cap
    bound = max(tokens.sum() / 2048, 3000 / 6, loss.sum() / 1024)
    assert box.max() + 1 <= 1.2 * bound  # two of the limits are tight at once
    wide = packing.pack(np.array([10, 3000]), np.array([2000, 5]), limits)
    assert len(set(wide.tolist())) == 2
    assert len(packing.pack(np.array([], int), np.array([], int), limits)) == 0


def test_documents_are_packed_whole(spark):
    rnd = random.Random(8)
    texts = [None, "", "a", "a", text(rnd, 9000), "user: hidden words\nagent: shown words\n"] + [text(rnd, rnd.randrange(5, 300)) for _ in range(150)]
    df = documents(spark, texts).withColumn("tokens", F.lit("x")).withColumn("piece", F.lit(1))
    encode = packing._encoding(packing.VOCABULARY)[0].encode_ordinary
    for group_rows in (packing.GROUP_ROWS, 40):
        out = packing.pack_documents(df, group_rows=group_rows).toPandas()
        assert out.groupby("doc_id")["tokens"].sum().to_dict() == {i: len(encode(t or "")) for i, t in enumerate(texts)}
        placed = out[out["seq_id"].notna()]
        assert placed.groupby("seq_id")["tokens"].sum().max() <= 2048
        assert set(out[out["seq_id"].isna()]["doc_id"]) == {0, 1}
        assert (placed[placed["doc_id"] != 4].groupby("doc_id").size() == 1).all()
        assert sorted(placed[placed["doc_id"] == 4]["tokens"])[1:] == [2048] * (len(placed[placed["doc_id"] == 4]) - 1)
        assert (out[out["doc_id"] == 5]["loss"] == len(encode(texts[5])) - len(encode("user: hidden words\n"))).all()
        assert placed["tokens"].sum() / (placed["seq_id"].nunique() * 2048) > 0.9
    limits = packing.Limits(2048, 3, 1500)
    for group_rows in (packing.GROUP_ROWS, 40):  # all three limits bind, and nothing is cut that fits
        r = packing.packing_report(packing.pack_documents(df, limits, group_rows=group_rows), limits).first()
        assert (r.texts, r.empty_texts, r.over_tokens, r.over_segments, r.over_loss, r.split_texts, r.broken_texts) == (len(texts), 2, 0, 0, 0, 0, 0)
        assert r.least_sequences <= r.sequences <= 1.7 * r.least_sequences and r.full_segments > 0
    both = packing.pack_documents(df.where("doc_id = 2").union(df.where("doc_id = 2"))).toPandas()
    assert len(both) == 2 and both["copy"].nunique() == 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_loss_is_counted_at_the_tokens():
    encoding, lengths = packing._encoding(packing.VOCABULARY)
    said = "user: naïve “words” here\nagent: shown ✓ words\ntool: " + "x" * 50 + "\nagent: more\nuser: no line end"
    tokens = np.array(encoding.encode_ordinary(said))
    bearing = packing.loss_bearing(said, tokens, lengths, ("user: ", "tool: "))
    shown = encoding.decode([int(t) for t, b in zip(tokens, bearing) if b])
    assert "shown ✓ words" in shown and "agent: more" in shown and "x" * 5 not in shown and "here" not in shown and "no line end" not in shown
    assert packing.loss_bearing("plain", np.array(encoding.encode_ordinary("plain")), lengths, ("user: ",)).all()


# --- leakage


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(6)
    items = [(k, text(rnd, rnd.randrange(8, 50)), f"answer{k}") for k in range(20)] + [(90, None, None), (91, "", "x"), (None, "y", "z")]
    docs = []
    for k in range(60):
        words = text(rnd, rnd.randrange(0, 200)).split()
        source = items[k % 20][1].split()
        n = rnd.choice([5, 9, 10, 11, 30])
        at = rnd.randrange(max(1, len(source) - n))
        words[len(words) // 2 : len(words) // 2] = source[at : at + n]
        docs.append(" ".join(words))
    docs += [None, "", items[3][1], items[3][1], text(rnd, 30_000) + " " + items[4][1]]
    grams = lambda t: {tuple(w[i : i + 10]) for w in [tokenize(t or "")] for i in range(len(w) - 9)}
    want = {(d, i) for d, t in enumerate(docs) for i, x, _ in items if i is not None and grams(t) & grams(x)}
    table = spark.createDataFrame(items, "item_id bigint, item_text string, answer string")
    df = documents(spark, docs).withColumn("pos", F.lit("x")).withColumn("codes", F.lit(1))
    assert {tuple(r) for r in leakage.leaked_runs(df, table).collect()} == want and want
    assert leakage.leaked_runs(df.limit(0), table).count() == 0
    assert leakage.leaked_runs(df, table.limit(0)).count() == 0
    in_blocks = leakage.leaks(df, table, least_run=10, item_block=6).select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in in_blocks.collect()} == want


def test_paraphrases_are_found_without_a_long_run(spark):
    rnd = random.Random(2)
    item = text(rnd, 24).split()
    changed = [w if k % 6 else rnd.choice(WORDS) for k, w in enumerate(item)]
    docs = documents(spark, [" ".join(changed), text(rnd, 300)])
    items = spark.createDataFrame([(1, " ".join(item), changed[1])], "item_id bigint, item_text string, answer string")
    got = leakage.paraphrases(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.answer) for r in got] == [(0, 1, True)] and got[0].lcs_share >= 0.7
    assert leakage.leaked_runs(docs, items).count() == 0


def test_paraphrases_are_found_wherever_they_begin(spark):
    rnd = random.Random(12)
    words = rnd.sample(WORDS, 200)
    items = [(1, " ".join(words[:60]), "x"), (2, " ".join(words[60:80]), "y"), (3, " ".join(words[80:88]), "z")]
    docs = []
    for begin in range(13):  # 24 tokens of the first item, two of them changed, at every distance from the stride
        part = words[6 + begin : 30 + begin]
        part[7], part[15] = "other", "words"
        docs.append(" ".join([*rnd.sample(words[100:], 12 - begin), *part, *rnd.sample(words[100:], 30)]))
    docs += [" ".join([*rnd.sample(words[100:], 17), *words[60:80], *rnd.sample(words[100:], 30)]), " ".join([*rnd.sample(words[100:], 5), *words[80:88], *rnd.sample(words[100:], 30)])]
    table = spark.createDataFrame(items, "item_id bigint, item_text string, answer string")
    got = {(r.doc_id, r.item_id): r.lcs_share for r in leakage.paraphrases(documents(spark, docs), table).collect()}
    assert set(got) == {(d, 1) for d in range(13)} | {(13, 2), (14, 3)}
    assert all(got[d, 1] >= 22 / 24 for d in range(13)) and got[13, 2] == got[14, 3] == 1
    in_blocks = leakage.paraphrases(documents(spark, docs), table, item_block=1).select("doc_id", "item_id")
    assert {tuple(r) for r in in_blocks.collect()} == set(got)


def test_checks_equal_dynamic_programming():
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 5, (40, 9)).astype(np.int32), rnd.integers(0, 5, (40, 7)).astype(np.int32)
    for x, y, run, lcs in zip(a, b, leakage.common_runs(a, b), leakage.common_subsequences(a, b)):
        r, t = np.zeros((10, 8), int), np.zeros((10, 8), int)
        for i in range(9):
            for j in range(7):
                r[i + 1, j + 1] = r[i, j] + 1 if x[i] == y[j] else 0
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        assert (run, lcs) == (r.max(), t[9, 7])
    pairs = np.arange(40)
    assert (leakage.masked_subsequences(a, pairs, leakage.place_masks(b, 5), 7) == leakage.common_subsequences(a, b)).all()


# --- wrong encodings

CLEAN = [
    "naïve façade, rôle and café — that’s all… “quoted” €5",
    "Größe und Schlüssel müssen übereinstimmen, außerdem ändert sich nichts.",
    "Le décalage mesuré dépasse où que soit l’élève; « déjà » là.",
    "¿Quién cambió la opción de mañana? Señor, está aquí.",
    "A configuração não está após a manutenção; três cópias além.",
    "Należy sprawdzić, czy ścieżka została usunięta, więc źródło.",
    "Ошибка в модуле исчезла через несколько минут, потому что ключ заменён.",
]
RARE = ["Cost: £40 or 45 €", "a 3 × 4 grid at 20 °C", "ATENÇÃO: NÃO REINICIAR", "CHÂSSIS N° 4", "ÄNDERUNG § 3", "Maß: 25 °C ± 0,5 µs", "¿Ñandú?", "√2 ≈ 1,41 ≠ π", "« À L’ÉTÉ »", "AMANHÃ», disse", "«СССР» — АР…", "order—because — that’s", "10 m² and 5 m³, see note¹"]


def misread(s, charset):
    return "".join(bytes([b]).decode(charset, "ignore") or chr(b) for b in s.encode())


@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251"])
def test_round_trip(charset):
    for s in CLEAN:
        bad = misread(s, charset)
        assert mojibake.is_damaged(bad), (charset, s)
        if charset in ("cp1252", "latin-1"):
            assert mojibake.restore(bad) == s
            assert mojibake.restore(misread(bad, charset)) == s
            assert mojibake.restore(s + "\n" + bad) == s + "\n" + s


def test_single_byte_mixups():
    for s, written, read in ((CLEAN[5], "cp1250", "cp1252"), (CLEAN[6], "koi8_r", "cp1251"), (CLEAN[6], "cp1251", "cp1252")):
        assert mojibake.restore(s.encode(written).decode(read)) == s
    assert "décalage mesuré dépasse" in mojibake.restore(CLEAN[2].encode("mac_roman").decode("cp1252", "ignore"))


@pytest.mark.parametrize("line", ["a → b → c {}", "≥ 5 ✓ {} 🎉", "{} ⇒ ✗ ★ ≠", "→ {}"])
def test_signs_do_not_outvote_a_damaged_word(line):
    bad = line.format("défaut".encode("mac_roman").decode("cp1252"))
    assert mojibake.restore(bad) == line.format("défaut") and mojibake.is_damaged(bad)
    assert not mojibake.is_damaged(line.format("défaut"))


def test_two_kinds_of_damage_in_one_line():
    polish, russian, french = CLEAN[5].encode("cp1250").decode("cp1252"), CLEAN[6].encode("koi8_r").decode("cp1251"), "dŽfaut rŽglŽ"
    for parts in itertools.permutations([(polish, CLEAN[5]), (russian, CLEAN[6]), (french, "défaut réglé")]):
        got = mojibake.restore(" ".join(bad for bad, _ in parts))
        assert "défaut réglé" in got and "usunięta" in got and "исчезла через" in got
    for s in ("Değişiklik ığdır şöyle çalıştığı için yapıldı", "Þetta er það sem við gerðum í gær"):
        assert mojibake.restore(s + " dŽfaut") == s + " défaut"


def test_undamaged_text_is_left_alone():
    for s in [*CLEAN, *RARE, "", "plain", None]:
        assert mojibake.restore(s) == s and not mojibake.is_damaged(s), s


def test_repair_table(spark):
    bad = misread(CLEAN[0], "cp1252")
    df = documents(spark, [CLEAN[0], bad, None, "", "lost �", "x" * 200_000 + bad]).withColumn("restored", F.lit(1))
    got = {r.doc_id: (r.restored, r.complete, r.route) for r in mojibake.repair_encoding(df).collect()}
    assert got == {1: (CLEAN[0], True, "bytes"), 4: ("lost �", False, "lost"), 5: ("x" * 200_000 + CLEAN[0], True, "bytes")}
    mixed = "dŽfaut rŽglŽ\n" + bad + " �"
    assert mojibake.restored_by(mixed) == ("défaut réglé\n" + CLEAN[0] + " �", "bytes+letters+lost")
    assert mojibake.repair_encoding(df.limit(0)).count() == 0
    assert mojibake.restore(misread("Für Ärger. Où ça?", "cp1252")) == "Für Ärger. Où ça?"


def test_any_number_of_layers_is_undone():
    deep = "„Größe“ – naïve"
    for _ in range(12):
        deep = misread(deep, "latin-1")
    assert mojibake.restore(deep) == "„Größe“ – naïve"
