"""Near-duplicate records with small edits: deletion-variant signatures.

A record's token set gets a signature of ``segments * width`` MinHash positions, each of which two sets
share with the probability of their Jaccard similarity. The signature is cut into few, wide segments,
few enough that one of them differs in at most one position, and each segment is indexed by its
one-wildcard variants: the segment with one position left out. Two segments that differ in at most one
position share a variant, so an equality join on variants yields every pair that has such a segment.
Candidates are compared by a 32-bit sketch in the task that joins them, by a 128-bit one, and then exactly.

MinHash positions take the place of the signature's bits: single bits tell sets of similarity 0.7 and
0.1 apart too weakly to be joined on a segment at any width that keeps the recall.

Recall at similarity s: 1 - (1 - s^w - w s^(w-1) (1-s))^segments; with the defaults 0.98 at exactly
0.70, 0.997 at 0.75, above 0.9998 from 0.80. The sketches take 0.0008 from that at 0.70 and 0.0001 at 0.75
at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical
from mnemolake.functions.text import tokenize
from mnemolake.llm.components import components
from mnemolake.operators.skew import HOT_ROWS, salted_join
from mnemolake.session import Scratch

SEGMENTS, WIDTH = 10, 7
SKETCH = 64
SKETCH_AGREE = 38
"""Two-bit sketch positions, of 64, that must agree: 3.5 standard deviations below the mean at similarity 0.7."""
SHORT_BITS, SHORT_AGREE = 32, 20
"""One-bit positions of the short sketch, and how many must agree: 3.6 standard deviations below the mean at similarity 0.7."""
BLOCK = 4096
"""Members of one variant that a task compares at once; larger groups are cut into blocks of pairs."""
PART_ROWS = 4_000_000
"""Variants that one task joins, on average; so a task holds the same at every size."""
PACK_SETS = 60_000
"""Sets whose variants are packed together for the shuffle; their places take two bytes."""
HELD_ROWS = 16_000_000
"""Variants a task holds before it lets go of those that too many sets share."""
MEMBERS = 1_000
"""Members of one class, or of one side of a link, that a row expands against as many others."""

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: 64-bit finalizer


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


def token_sets(bodies: list, tags: list, least_body: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Rows with enough body tokens; their sorted distinct token hashes, flattened, and the lengths."""
    keep, flat, lengths, known = [], [], [], {}
    for i, (body, tag) in enumerate(zip(bodies, tags)):
        words = set(tokenize(body)) if body else set()
        if len(words) < least_body:
            continue
        for t in tag or ():
            if t:
                words.update(tokenize(t))
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            hashes.append(h)
        hashes.sort()
        keep.append(i)
        flat.extend(hashes)
        lengths.append(len(hashes))
    return keep, np.array(flat, np.uint64), np.array(lengths, np.int64)


def set_ids(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each token set."""
    with np.errstate(over="ignore"):
        total = np.add.reduceat(_mix(flat ^ np.uint64(0x9E3779B97F4A7C15)), starts)
        twist = np.bitwise_xor.reduceat(_mix(flat + _M1), starts)
        return _mix(total ^ _mix(twist ^ (lengths.astype(np.uint64) * _M2))).astype(np.int64)


def short_sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest bit of each of ``SHORT_BITS`` positions."""
    bits = (sig[:, :SHORT_BITS] & np.uint32(1)).astype(np.uint64)
    return (bits << np.arange(SHORT_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.uint32)


def signatures(flat: np.ndarray, starts: np.ndarray, positions: int, seed: int = 0) -> np.ndarray:
    """MinHash positions, two from each 64-bit hash of the tokens."""
    out = np.empty((len(starts), positions + positions % 2), np.uint32)
    for j in range(0, positions, 2):
        mixed = _mix(flat ^ _mix(np.array([(seed << 20) + j + 1], np.uint64))[0])
        out[:, j] = np.minimum.reduceat((mixed >> np.uint64(32)).astype(np.uint32), starts)
        out[:, j + 1] = np.minimum.reduceat(mixed.astype(np.uint32), starts)
    return out[:, :positions]


def variants(sig: np.ndarray, segments: int, width: int) -> np.ndarray:
    """Keys of the one-wildcard variants, ``segments * width`` a row."""
    n = len(sig)
    keys = np.empty((n, segments * width), np.uint64)
    with np.errstate(over="ignore"):
        for s in range(segments):
            # a sum of position-salted hashes: leaving one position out is a subtraction
            cells = np.stack([_mix(sig[:, s * width + p].astype(np.uint64) + np.uint64((s * width + p + 1) << 32)) for p in range(width)], axis=1)
            whole = cells.sum(axis=1, dtype=np.uint64)
            for p in range(width):
                keys[:, s * width + p] = _mix(whole - cells[:, p] + np.uint64(s * width + p))
    return keys


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two 64-bit words: the low and the high of two bits of each of the first 64 positions."""
    bits = sig[:, :SKETCH].astype(np.uint64)
    place = np.arange(SKETCH, dtype=np.uint64)
    low = ((bits & np.uint64(1)) << place).sum(axis=1, dtype=np.uint64)
    high = (((bits >> np.uint64(1)) & np.uint64(1)) << place).sum(axis=1, dtype=np.uint64)
    return np.stack([low, high], axis=1).astype(np.int64)


def _list_array(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat.astype(np.int64)))


def _sets_op(batches: Iterator[pa.RecordBatch], least_body: int) -> Iterator[pa.RecordBatch]:
    """Token sets and their sketches, from positions apart from those the join uses."""
    for b in batches:
        keep, flat, lengths = token_sets(b.column("body").to_pylist(), b.column("tags").to_pylist(), least_body)
        if not keep:
            continue
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sig = signatures(flat, starts, SKETCH + SHORT_BITS, seed=1)
        sk = sketch(sig)
        ids = b.column("id").take(pa.array(keep, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(set_ids(flat, starts, lengths)), pa.array(lengths.astype(np.int32)), pa.array(sk[:, 0]), pa.array(sk[:, 1]), pa.array(short_sketch(sig[:, SKETCH:]).astype(np.int64)), _list_array(flat, lengths)],
            names=["id", "set_id", "size", "low", "high", "short", "tokens"],
        )


def _packed(ids: np.ndarray, size: np.ndarray, short: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """The variants of many sets as one blob for each part they go to: 4 bytes of key and 2 of place for each
    variant, and each set that has any in the part once. The part takes the other half of a key."""
    per = keys.shape[1]
    part = ((keys.ravel() >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort((part.astype(np.uint64) << np.uint64(32)) | (keys.ravel() & np.uint64(0xFFFFFFFF)))
    part, low, place = part[order], keys.ravel()[order].astype(np.uint32), (order // per).astype(np.int64)
    ends = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [True]])) + 1
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        used, at = np.unique(place[lo:hi], return_inverse=True)
        head = np.array([hi - lo, len(used)], np.int64)
        yield int(part[lo]), b"".join(x.tobytes() for x in (head, ids[used], short[used], size[used], low[lo:hi], at.astype(np.uint16)))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, id, short sketch and size of each variant of a blob."""
    n, m = np.frombuffer(blob, np.int64, 2).tolist()
    at, out = 16, []
    for kind, count in ((np.int64, m), (np.uint32, m), (np.uint16, m), (np.uint32, n), (np.uint16, n)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    ids, short, size, key, place = out
    return key, ids[place], short[place], size[place]


def _variants_op(batches: Iterator[pa.RecordBatch], segments: int, width: int, parts: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        blobs = list(_packed(*(np.concatenate(x) for x in zip(*held)), parts))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["part", "blob"])

    for b in batches:
        lists = b.column(3)
        flat, lengths = lists.flatten().to_numpy().astype(np.uint64), lists.value_lengths().to_numpy().astype(np.int64)
        if not len(lengths):
            continue
        keys = variants(signatures(flat, np.concatenate([[0], np.cumsum(lengths)[:-1]]), segments * width), segments, width)
        size = np.minimum(b.column(1).to_numpy(), 65535).astype(np.uint16)
        if held and sum(len(h[0]) for h in held) + len(lengths) > PACK_SETS:
            yield flush()
        held.append((b.column(0).to_numpy(), size, b.column(2).to_numpy().astype(np.uint32), keys))
    if held:
        yield flush()


def _pairs_within(key: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of equal key, from an array sorted by key: neighbours at distance 1, then 2, and so on.

    ``counts`` is the size of each row's group; groups that are done leave, so a few large ones do not
    keep all the others in the loop.
    """
    at, d = np.arange(len(key)), 1
    while True:
        more = counts > d
        if more.sum() < 0.7 * len(more):
            key, at, counts = key[more], at[more], counts[more]
        hit = np.flatnonzero(key[d:] == key[:-d])
        if not len(hit):
            return
        yield at[hit], at[hit + d]
        d += 1


def may_match(short_a: np.ndarray, short_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sizes and short sketches of two sets allow the similarity."""
    x, y = size_a.astype(np.float64), size_b.astype(np.float64)
    sized = (np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9) | (x == 65535) | (y == 65535)
    return sized & (np.bitwise_count(short_a ^ short_b) <= SHORT_BITS - SHORT_AGREE)


def _match_op(batches: Iterator[pa.RecordBatch], block: int, threshold: float, held_rows: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each variant; members of groups over ``block`` come out as (key, member) rows instead.

    The blobs stream in. Beyond ``held_rows`` the groups over ``block`` are sent out and what joins them later
    passes through, so what is held does not grow with the most popular variant.
    """
    names, held, count, hot = ["a", "b", "key", "short", "size"], [], 0, np.zeros(0, np.int64)

    def members(key: np.ndarray, ids: np.ndarray, short: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(key), pa.array(short.astype(np.int64)), pa.array(size.astype(np.int32))], names=names)

    def sorted_rows() -> tuple[list[np.ndarray], np.ndarray]:
        cols = [np.concatenate(x) for x in zip(*held)]
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        fresh = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        cols = [c[fresh] for c in cols]
        starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        counts = np.diff(np.concatenate([starts, [len(cols[0])]]))
        return cols, np.repeat(counts, counts)

    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            key, *rest = _unpacked(blob)
            row = [(np.int64(part) << np.int64(32)) | key.astype(np.int64), *rest]
            if len(hot):
                known = np.isin(row[0], hot)
                if known.any():
                    yield members(*(c[known] for c in row))
                    row = [c[~known] for c in row]
            held.append(row)
            count += len(row[0])
            if count > held_rows:
                cols, sizes = sorted_rows()
                large = sizes > block
                if large.any():
                    hot = np.union1d(hot, cols[0][large])
                    yield members(*(c[large] for c in cols))
                held[:] = [[c[~large] for c in cols]]
                count = len(held[0][0])
                held_rows = max(held_rows, 2 * count)
    if not count:
        return
    (key, ids, short, size), sizes = sorted_rows()
    held.clear()
    large, several = sizes > block, (sizes > 1) & (sizes <= block)
    if large.any():
        yield members(key[large], ids[large], short[large], size[large])
    key, ids, short, size = key[several], ids[several], short[several], size[several]
    kept: list[np.ndarray] = []
    waiting = 0

    def pairs() -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate(kept), axis=0)  # a pair that shares several variants here comes out once
        kept.clear()
        for at in range(0, len(found), 100_000):
            x = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x["a"]), pa.array(x["b"]), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int32())], names=names)

    for x, y in _pairs_within(key, sizes[several]):
        for at in range(0, len(x), 1_000_000):
            p, q = x[at : at + 1_000_000], y[at : at + 1_000_000]
            likely = may_match(short[p], short[q], size[p], size[q], threshold)
            u, v = ids[p[likely]], ids[q[likely]]
            pair = np.empty(len(u), [("a", np.int64), ("b", np.int64)])
            pair["a"], pair["b"] = np.minimum(u, v), np.maximum(u, v)
            kept.append(pair)
            waiting += len(pair)
            if waiting > 1_000_000:
                yield from pairs()
                waiting = 0
    if kept:
        yield from pairs()


def near_duplicate_sets(sets: DataFrame, n_sets: int, scratch: Scratch, threshold: float, segments: int, width: int, block: int, part_rows: int = PART_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """Pairs (a, b, similarity) of different token sets, a < b, with at least ``threshold`` in common.

    ``sets`` has each set once and is bucketed by set_id, so sketches and tokens are joined where they lie.
    """
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-n_sets * segments * width // part_rows))
    packed = sets.select("set_id", "size", "short", "tokens").mapInArrow(lambda it: _variants_op(it, segments, width, parts), "part int, blob binary")
    matched = packed.repartitionById(parts, "part").mapInArrow(lambda it: _match_op(it, block, threshold, held_rows), "a bigint, b bigint, key bigint, short bigint, size int")
    matched = scratch.write(matched, "matched")
    sized = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9
    candidates = matched.where(F.col("key").isNull()).select("a", "b")
    # Groups too large for one task: members are dealt to chunks and every pair of chunks is a key of its own.
    members = matched.where(F.col("key").isNotNull()).select("key", F.col("a").alias("set_id"), "short", "size")
    if members.take(1):
        counts = scratch.write(members.groupBy("key").agg(F.count("*").alias("n")), "hot")
        chunks = F.ceil(F.col("n") / block).cast("int")
        dealt = salted_join(members, counts, ["key"], "n", [F.col("set_id")]).withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("set_id"), chunks).cast("int")})
        sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "set_id", "short", "size")
        one = lambda c, at: sides.where(F.col("chunk") == F.col(at)).select("key", "i", "j", F.col("set_id").alias(c), F.col("short").alias(f"{c}_short"), F.col("size").alias(f"{c}_size"))
        near = F.bit_count(F.col("x_short").bitwiseXOR(F.col("y_short"))) <= SHORT_BITS - SHORT_AGREE
        blocked = one("x", "i").join(one("y", "j"), ["key", "i", "j"]).where((F.col("x") != F.col("y")) & sized("x_size", "y_size") & near)
        candidates = candidates.unionByName(blocked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    # partitioned by one side only, which serves both the removal of repeats and the join that follows
    candidates = candidates.repartition("a").distinct()

    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("size").alias(f"{c}_size"), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
    differ = F.bit_count(F.col("a_low").bitwiseXOR(F.col("b_low")).bitwiseOR(F.col("a_high").bitwiseXOR(F.col("b_high"))))
    close = candidates.join(side("a"), "a").join(side("b"), "b").where(sized("a_size", "b_size") & (differ <= SKETCH - SKETCH_AGREE)).select("a", "b")
    close = scratch.write(close, "close")
    scratch.drop("matched", "hot")
    tokens = lambda c: sets.select(F.col("set_id").alias(c), F.col("tokens").alias(f"t{c}"))
    both = close.join(tokens("a"), "a").join(tokens("b"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    similarity = shared / (F.size("ta") + F.size("tb") - shared)
    return scratch.write(both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold), "similar")


def near_duplicates(records: DataFrame, threshold: float = 0.7, least_body: int = 8, segments: int = SEGMENTS, width: int = WIDTH, block: int = BLOCK, **parameters: int) -> tuple[DataFrame, DataFrame]:
    """(classes, links): records grouped by equal token set, and pairs of sets alike enough.

    classes: id, set_id; links: a, b, similarity. Copies are never expanded against each other here, so a
    record copied a million times costs one row a task.

    Defined cases: tokens are those of body and tags together; rows with null id, or with fewer than
    ``least_body`` distinct body tokens (so null and empty bodies), are left out; null tags are none;
    repeated rows of an id with equal tokens are one member; other columns are ignored; an empty table
    gives empty results.
    """
    scratch = Scratch(records.sparkSession, "neardup")
    rows = records.where(F.col("id").isNotNull()).select(canonical("id").alias("id"), "body", "tags")
    sets = scratch.write(rows.mapInArrow(lambda it: _sets_op(it, least_body), "id string, set_id bigint, size int, low bigint, high bigint, short bigint, tokens array<bigint>"), "sets")
    members = scratch.write(sets.select("id", "set_id"), "members")
    unique = scratch.write_bucketed(sets.drop("id").dropDuplicates(["set_id"]), "unique", "set_id", sets.count())
    scratch.drop("sets")
    links = near_duplicate_sets(unique, unique.count(), scratch, threshold, segments, width, block, **parameters)
    scratch.drop("unique", "close")
    return members, links


def _sized_classes(scratch: Scratch, classes: DataFrame) -> DataFrame:
    return scratch.write(classes.groupBy("set_id").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id")), "sized")


def near_duplicate_groups(records: DataFrame, threshold: float = 0.7, hot_rows: int = HOT_ROWS, **parameters: int) -> DataFrame:
    """id, group_id, group_size, n_links: one row a record, in the group its links form directly or through others.

    ``group_id`` is the smallest id of the group, ``n_links`` the number of records that are at least
    ``threshold`` alike. Copies stay one class throughout, so nothing is expanded into pairs. A record
    without a partner is a group of its own; records that ``near_duplicates`` leaves out have no row.
    """
    scratch = Scratch(records.sparkSession, "groups")
    classes, links = near_duplicates(records, threshold, **parameters)
    sized = _sized_classes(scratch, classes)
    ends = links.select(F.col("a").alias("set_id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("set_id"), F.col("a").alias("to")))
    degrees = scratch.write(ends.groupBy("to").agg(F.count("*").alias("degree")).join(sized.select(F.col("set_id").alias("to"), "n"), "to"), "degrees")
    partners = salted_join(ends, degrees, ["to"], "degree", [F.col("set_id")], hot_rows=hot_rows).groupBy("set_id").agg(F.sum("n").alias("others"))
    rooted = sized.join(components(links, hot_rows).withColumnRenamed("node", "set_id"), "set_id", "left").join(partners, "set_id", "left")
    rooted = scratch.write(rooted.select("set_id", "n", "first_id", F.coalesce("root", "set_id").alias("root"), F.coalesce("others", F.lit(0)).alias("others")), "rooted")
    groups = scratch.write(rooted.groupBy("root").agg(F.min("first_id").alias("group_id"), F.sum("n").alias("group_size"), F.count("*").alias("sets")), "grouped")
    told = salted_join(rooted, groups, ["root"], "sets", [F.col("set_id")], hot_rows=hot_rows)
    told = scratch.write(told.select("set_id", "n", "group_id", "group_size", (F.col("n") - 1 + F.col("others")).alias("n_links")), "told")
    return salted_join(classes.distinct(), told, ["set_id"], "n", [F.col("id")], hot_rows=hot_rows).select("id", "group_id", "group_size", "n_links")


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.7, members: int = MEMBERS, **parameters: int) -> DataFrame:
    """All pairs of records (id_a < id_b) at least ``threshold`` alike, copies included.

    The members of a class are dealt to chunks of about ``members``, and every pair of chunks of one class, or
    of two linked ones, is a row of its own before it is expanded; so no class, however large, is expanded
    against itself in one task.
    """
    scratch = Scratch(records.sparkSession, "pairs")
    classes, links = near_duplicates(records, threshold, **parameters)
    classes = classes.distinct()
    sized = _sized_classes(scratch, classes).select("set_id", "n", F.ceil(F.col("n") / members).cast("int").alias("chunks"))
    large = sized.where("chunks > 1")
    if large.take(1):  # the rest has one chunk and needs no deal
        dealt = salted_join(classes.join(large.select("set_id"), "set_id", "left_semi"), scratch.write(large, "large"), ["set_id"], "n", [F.col("id")])
        dealt = dealt.select("set_id", "id", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
        classes = dealt.unionByName(classes.join(large.select("set_id"), "set_id", "left_anti").select("set_id", "id", F.lit(0).alias("chunk")))
    else:
        classes = classes.select("set_id", "id", F.lit(0).alias("chunk"))
    classes = scratch.write(classes, "classes")
    chunk = lambda s, c, i: classes.select(F.col("set_id").alias(s), F.col("chunk").alias(i), F.col("id").alias(c))
    many = sized.where("n > 1").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.col("chunks").alias("ca"), F.col("chunks").alias("cb"))
    side = lambda c: sized.select(F.col("set_id").alias(c), F.col("chunks").alias(f"c{c}"))
    blocks = many.unionByName(links.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb"))
    blocks = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ca") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cb") - 1))).select("a", "b", "i", "j")
    met = blocks.join(chunk("a", "x", "i"), ["a", "i"]).join(chunk("b", "y", "j"), ["b", "j"])
    # within a class every unordered pair of members meets twice; the greater side is dropped
    return met.where((F.col("a") != F.col("b")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
