"""Evaluation texts leaking into the corpus: latent semantic retrieval, then exact checks.

Documents are cut into overlapping passages; the TF-IDF matrix of all passages that could match an item
is factorised by a distributed randomised SVD; passages and item passages are compared in the latent space, and
the candidates are checked token by token: longest common run, longest common subsequence, and whether the
answer's tokens stand in the passage.

Where a common run is asked for, the search loses nothing. A product of two passages is their latent product
and the product of what the latent space leaves of them, which is at most that of the two remainders' lengths;
and two passages with a common run have at least the run's own weight in common. So a pair is a candidate if
latent product and remainders together reach the smallest weight a run of either passage can have.

Only tokens the items use have a coordinate, since any other adds nothing to a product with an item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.text import tokenize
from mnemolake.session import Scratch

RANK = 64
ITEM_BLOCK = 2_000
"""Items that one pass holds; more are taken in blocks, each a pass over the corpus."""
COLUMNS = 8_192
"""Item passages that one matrix product takes."""
FOLLOW_BLOCK = 2_000
"""The same for paraphrases, whose pass holds one cell for each item segment and token."""
MASK_CELLS = 32_000_000
"""Cells of the place masks that a task holds; beyond, subsequences are counted cell by cell."""
FAN_IN = 64
"""Sums that one task adds up."""


@dataclass(frozen=True)
class Passages:
    """How passages are cut and which can match.

    A passage qualifies with ``least_run`` known tokens in a row and ``least_known`` in all, known being
    those that occur in the items. With ``window - stride + 1 >= least_run`` every common run of
    ``least_run`` tokens lies whole in one qualifying passage on both sides. A passage keeps ``reach`` more
    tokens behind its window: with ``stride - 1`` of them every window of the text lies whole in one passage.
    """

    window: int = 12
    stride: int = 3
    least_run: int = 10
    least_known: int = 10
    reach: int = 0

    def cut(self, codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
        n = len(codes)
        if n == 0:
            return []
        known = codes >= 0
        starts = np.arange(0, max(1, n - self.window + self.stride), self.stride)
        ends = np.minimum(starts + self.window + self.reach, n)
        total = np.concatenate([[0], np.cumsum(known)])
        ok = total[ends] - total[starts] >= self.least_known
        if self.least_run > 1 and ok.any():
            r = self.least_run
            if n < r:
                return []
            full = np.concatenate([[0], np.cumsum(total[r:] - total[:-r] == r)])
            top = np.minimum(np.maximum(ends - r + 1, starts), len(full) - 1)
            ok &= full[top] - full[np.minimum(starts, len(full) - 1)] > 0
        return [(int(s), codes[s:e]) for s, e in zip(starts[ok], ends[ok])]


@dataclass
class Items:
    """The items of one block: their tokens as codes, and their passages."""

    ids: list[int]
    vocabulary: dict[str, int]
    codes: list[np.ndarray]
    answers: list[np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Items:
        vocabulary: dict[str, int] = {}
        encode = lambda text: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokenize(text or "")], np.int32)
        codes = [encode(r[1]) for r in rows]
        return cls([r[0] for r in rows], vocabulary, codes, [encode(r[2]) for r in rows])


def _cut_op(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int], passages: Passages) -> Iterator[pa.RecordBatch]:
    """Passages of all documents; at the end one row with the document frequencies this task has seen."""
    frequency = np.zeros(len(vocabulary) + 1, np.int64)
    documents = 0
    names = ["doc_id", "pos", "codes", "counts"]
    get = vocabulary.get
    for b in batches:
        ids, positions, parts, lengths = [], [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            documents += 1
            if not text:
                continue
            codes = np.array([get(w, -1) for w in tokenize(text)], np.int32)
            frequency[np.unique(codes)] += 1  # the unknown token counts in the last cell
            for at, part in passages.cut(codes):
                ids.append(doc)
                positions.append(at)
                parts.append(part)
                lengths.append(len(part))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(positions, pa.int32()), lists, pa.nulls(len(ids), pa.list_(pa.int64()))], names=names)
    frequency[-1] = documents
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([frequency.tolist()], pa.list_(pa.int64()))], names=names)


def _weighted_sums(flat: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each passage; unknown tokens have a last row of zeros."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.add.reduceat(table[flat], starts, axis=0)


def _gram_op(batches: Iterator[pa.RecordBatch], basis: np.ndarray, idf: np.ndarray) -> Iterator[pd.DataFrame]:
    """This task's share of (transposed A) A times ``basis``, A being the unit TF-IDF rows of the passages."""
    from pyspark import TaskContext

    terms, rank = basis.shape
    out = np.zeros((terms, rank))
    table = np.vstack([idf[:, None] * basis, np.zeros((1, rank))])
    squares = np.concatenate([idf**2, [0.0]])
    for b in batches:
        lists = b.column(0)
        flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        if not len(flat):
            continue
        row = np.repeat(np.arange(len(lengths)), lengths)
        known = flat >= 0
        norm = np.maximum(np.bincount(row, weights=squares[flat], minlength=len(lengths)), 1e-12)
        y = _weighted_sums(flat, lengths, table) / norm[:, None]
        order = np.argsort(flat[known], kind="stable")
        code, of = flat[known][order], row[known][order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        out[code[first]] += idf[code[first], None] * np.add.reduceat(y[of], first, axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.astype(np.float64).tobytes()], pa.binary())], names=["part", "blob"])


def _sum_blobs(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pdf["blob"].iloc[0], np.float64).copy()
    for x in pdf["blob"].iloc[1:]:
        total += np.frombuffer(x, np.float64)
    return pd.DataFrame({"part": [pdf["part"].iloc[0] // FAN_IN], "blob": [total.tobytes()]})


def latent_basis(passages: DataFrame, idf: np.ndarray, rank: int, passes: int = 3, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix: randomised subspace iteration.

    Each pass multiplies a terms-by-rank block by the Gram matrix, one sum a task. The tasks' sums are added
    up in a tree of FAN_IN sums a node, as high as the number of tasks needs; only its top, whose size the
    items bound, comes to the driver.
    """
    rank = min(rank, len(idf))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), rank)))[0]
    chosen = passages.select("codes")
    tasks = chosen.rdd.getNumPartitions()
    for _ in range(passes):
        sums = chosen.mapInArrow(lambda it, q=basis: _gram_op(it, q, idf), "part bigint, blob binary")
        left = tasks
        while left > 1:
            sums = sums.groupBy(F.floor(F.col("part") / FAN_IN).alias("node")).applyInPandas(_sum_blobs, "part bigint, blob binary")
            left = -(-left // FAN_IN)
        gram = np.zeros((len(idf), rank))
        for r in sums.collect():  # one row
            gram += np.frombuffer(r.blob, np.float64).reshape(gram.shape)
        small, last = basis.T @ gram, basis
        basis = np.linalg.qr(gram)[0]
    return last @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]


def padded(flat: np.ndarray, lengths: np.ndarray, width: int, blank: int) -> np.ndarray:
    """Passages as rows of one matrix; unknown and missing tokens are ``blank``, which matches nothing."""
    out = np.full((len(lengths), width), blank, np.int32)
    at = np.arange(width)[None, :] < lengths[:, None]
    out[at] = np.where(flat < 0, blank, flat)
    return out


def common_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common run of each pair of rows: one vector step for each column of ``a``."""
    run = np.zeros((len(a), b.shape[1] + 1), np.int16)
    best = np.zeros(len(a), np.int16)
    for i in range(a.shape[1]):
        run[:, 1:] = np.where(b == a[:, i, None], run[:, :-1] + 1, 0)
        np.maximum(best, run.max(axis=1), out=best)
    return best


def common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows."""
    row = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for i in range(a.shape[1]):
        step = np.where(b == a[:, i, None], row[:, :-1] + 1, row[:, 1:])
        row[:, 1:] = np.maximum.accumulate(step, axis=1)
    return row[:, -1]


def place_masks(rows: np.ndarray, terms: int) -> np.ndarray | None:
    """For each row and term, the bits of the places where it stands; None where the table would be large."""
    if rows.shape[1] > 62 or len(rows) * (terms + 1) > MASK_CELLS:
        return None
    out = np.zeros((len(rows), terms + 1), np.uint64)
    for j in range(rows.shape[1]):
        at = np.flatnonzero(rows[:, j] >= 0)
        out[at, rows[at, j]] |= np.uint64(1 << j)
    return out


def masked_subsequences(a: np.ndarray, q: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """``common_subsequences`` by bit-parallel steps: one addition for each column of ``a``, over all pairs.

    Unknown tokens (negative) index the last, empty column of ``masks``.
    """
    full = np.uint64((1 << width) - 1)
    row = np.full(len(a), full)
    for i in range(a.shape[1]):
        hit = row & masks[q, a[:, i]]
        row = ((row + hit) | (row - hit)) & full
    return width - np.bitwise_count(row).astype(np.int32)


def run_hashes(rows: np.ndarray, run: int) -> np.ndarray:
    """Hash of every ``run`` consecutive tokens of each row; windows with a blank get a hash of their own."""
    wide = rows.astype(np.uint64)
    out = np.zeros((len(rows), max(1, rows.shape[1] - run + 1)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(out.shape[1]):
            for j in range(run):
                if k + j < rows.shape[1]:
                    out[:, k] = (out[:, k] ^ wide[:, k + j]) * np.uint64(0x9E3779B97F4A7C15)
                    out[:, k] ^= out[:, k] >> np.uint64(29)
    return out


def run_weights(rows: np.ndarray, squares: np.ndarray, run: int) -> np.ndarray:
    """The smallest weight of ``run`` known tokens in a row; infinite where there is no such run."""
    known = rows >= 0
    total = np.pad(np.cumsum(np.where(known, squares[rows], 0.0), axis=1), ((0, 0), (1, 0)))
    count = np.pad(np.cumsum(known, axis=1), ((0, 0), (1, 0)))
    if rows.shape[1] < run:
        return np.full(len(rows), np.inf)
    return np.where(count[:, run:] - count[:, :-run] == run, total[:, run:] - total[:, :-run], np.inf).min(axis=1)


def latent(rows: np.ndarray, table: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Latent coordinates of passages, and the length of what the latent space leaves of them."""
    z = np.zeros((len(rows), table.shape[1]))
    length = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        z += table[rows[:, j]]  # unknown and missing tokens take the last row, of zeros
        length += squares[rows[:, j]] * (rows == rows[:, j, None]).sum(axis=1)
    rest = np.sqrt(np.maximum(length - (z * z).sum(axis=1), 0.0))
    return np.hstack([z, rest[:, None]])


def _candidates(both: np.ndarray, index: np.ndarray, least_cosine: float, bounds: np.ndarray | None, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of passages and item passages that may match; with ``bounds`` none that could have a run is left out."""
    unit = lambda x: x[:, :-1] / np.maximum(np.linalg.norm(x[:, :-1], axis=1, keepdims=True), 1e-12)
    x, y = ((both, index) if bounds is not None else (unit(both), unit(index)))
    x, y, floor = x.astype(np.float32), y.astype(np.float32), (0.999 * weights).astype(np.float32)  # single precision: a thousandth of slack
    for at in range(0, len(x), 1024):
        mine = (0.999 * bounds[at : at + 1024, None]).astype(np.float32) if bounds is not None else np.float32(least_cosine)
        for col in range(0, len(y), COLUMNS):
            product = x[at : at + 1024] @ y[col : col + COLUMNS].T
            ok = product >= mine
            if bounds is not None:
                ok &= product >= floor[None, col : col + COLUMNS]
            p, q = np.nonzero(ok)
            yield p + at, q + col


def _search_op(batches: Iterator[pa.RecordBatch], items: Items, table: np.ndarray, squares: np.ndarray, owner: np.ndarray, least_cosine: float, item_parts: list[np.ndarray], window: int, least_run: int, least_lcs: float) -> Iterator[pa.RecordBatch]:
    """Candidates of all passages of a batch, then the checks, over all candidate pairs at once."""
    names = ["doc_id", "item_id", "pos", "cosine", "run", "lcs", "span", "answer"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    answers = [set(a.tolist()) for a in items.answers]
    ids = np.array(items.ids, np.int64)
    spans = np.array([len(p) for p in item_parts])
    flat_items = np.concatenate(item_parts)
    theirs = padded(flat_items, spans, window, -2)
    masks = place_masks(theirs, len(items.vocabulary))
    their_hashes = run_hashes(theirs, least_run) if least_run else None
    index = latent(padded(flat_items, spans, window, -1), table, squares)
    weights = run_weights(theirs, squares, least_run) if least_run else np.ones(len(theirs))
    for b in batches:
        lists = b.column(2)
        lengths = lists.value_lengths().to_numpy()
        if not len(lengths):
            continue
        doc, pos = b.column(0).to_numpy(), b.column(1).to_numpy()
        mine = padded(lists.flatten().to_numpy(), lengths, window, -1)
        my_hashes = run_hashes(mine, least_run) if least_run else None
        both = latent(mine, table, squares)
        for p, q in _candidates(both, index, least_cosine, run_weights(mine, squares, least_run) if least_run else None, weights):
            if least_run:
                shared = np.zeros(len(p), bool)
                for k in range(my_hashes.shape[1]):
                    own = my_hashes[:, k][p]
                    for other in range(their_hashes.shape[1]):
                        shared |= own == their_hashes[:, other][q]
                p, q = p[shared], q[shared]
            if not len(p):
                continue
            near = (both[p, :-1] * index[q, :-1]).sum(axis=1) / np.maximum(np.linalg.norm(both[p, :-1], axis=1) * np.linalg.norm(index[q, :-1], axis=1), 1e-12)
            lcs = masked_subsequences(mine[p], q, masks, window) if masks is not None else common_subsequences(mine[p], theirs[q])
            ok = lcs >= least_lcs * spans[q]
            p, q, near, lcs = p[ok], q[ok], near[ok], lcs[ok]
            run = common_runs(mine[p], theirs[q])
            ok = run >= least_run
            p, q, near, run, lcs = p[ok], q[ok], near[ok], run[ok], lcs[ok]
            if not len(p):
                continue
            told = [bool(answers[k]) and answers[k] <= set(mine[x].tolist()) for x, k in zip(p.tolist(), owner[q].tolist())]
            cols = (doc[p], ids[owner[q]], pos[p], near.astype(np.float64), run.astype(np.int32), lcs.astype(np.int32), spans[q].astype(np.int32), np.array(told, bool))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _blocks(items: DataFrame, item_block: int) -> Iterator[Items]:
    held = items.where(F.col("item_id").isNotNull()).select("item_id", "item_text", "answer")
    blocks = max(1, -(-held.count() // item_block))
    for k in range(blocks):
        yield Items.of(held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect())


def _passages(documents: DataFrame, block: Items, passages: Passages, scratch: Scratch, name: str) -> tuple[DataFrame, np.ndarray]:
    """The qualifying passages of all documents, and the inverse document frequencies of the items' tokens."""
    cut = scratch.write(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(lambda it, v=block.vocabulary: _cut_op(it, v, passages), "doc_id bigint, pos int, codes array<int>, counts array<bigint>"), name)
    seen = cut.where(F.col("counts").isNotNull()).select(F.posexplode("counts").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(block.vocabulary) + 1)
    for r in seen:
        counts[r.term] = r.n
    return cut.where(F.col("counts").isNull()).select("doc_id", "pos", "codes"), np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1


def leaks(documents: DataFrame, items: DataFrame, passages: Passages = Passages(), rank: int = RANK, least_cosine: float = 0.6, least_run: int = 0, least_lcs: float = 0.0, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Passage pairs close in latent space, with what the checks measured.

    Result: doc_id, item_id, pos (token at which the document passage begins), cosine, run and lcs
    (longest common run and subsequence, in tokens), span (tokens of the item passage), answer (all tokens
    of the item's answer stand in the passage). One row for each pair of passages that have a common run of
    ``least_run`` tokens and a common subsequence of ``least_lcs`` of the item passage. ``least_cosine`` counts
    only where no run is asked for; with ``least_run`` the latent bound of the module text decides, which no
    pair with such a run fails.

    Document frequencies, passages and the factorisation cover all documents; no sample, no cap on
    candidates. Every task streams its documents; nothing is shuffled but the small sums.

    Defined cases: null and empty texts have no passage; texts shorter than a window are one passage;
    null ids of items are dropped, null answers are never found; equal items each get their rows; repeated
    documents likewise; an empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    schema = "doc_id bigint, item_id bigint, pos int, cosine double, run int, lcs int, span int, answer boolean"
    out: DataFrame | None = None
    for k, block in enumerate(_blocks(items, item_block)):
        parts = [(i, p) for i, codes in enumerate(block.codes) for _, p in passages.cut(codes)]
        if not parts:
            continue
        qualifying, idf = _passages(documents, block, passages, scratch, f"passages{k}")
        basis = latent_basis(qualifying, idf, rank)
        table, squares = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]), np.append(idf**2, 0.0)
        owner = np.array([i for i, _ in parts])
        item_parts = [p for _, p in parts]
        found = qualifying.mapInArrow(lambda it, a=(block, table, squares, owner, least_cosine, item_parts, passages.window, least_run, least_lcs): _search_op(it, *a), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def leaked_runs(documents: DataFrame, items: DataFrame, run: int = 10) -> DataFrame:
    """(doc_id, item_id): a run of ``run`` consecutive tokens of the item stands in the document."""
    found = leaks(documents, items, Passages(run + 2, 3, run, run), least_run=run)
    return found.select("doc_id", "item_id").distinct()


@dataclass
class Segments:
    """The items' windows, in segments that share their tokens.

    Every window of ``window`` tokens of an item begins at one of the first ``offsets`` tokens of one
    segment; a shorter item, and the rest of an item behind its last whole stride, is a segment with one
    window as long as itself. ``need`` is the common subsequence that a window must reach.
    """

    owner: np.ndarray
    codes: list[np.ndarray]
    offsets: np.ndarray
    span: np.ndarray
    need: np.ndarray

    @classmethod
    def of(cls, items: Items, window: int, stride: int, share: float) -> Segments:
        rows: list[tuple[int, np.ndarray, int, int]] = []
        for i, codes in enumerate(items.codes):
            n = len(codes)
            for at in range(0, max(0, n - window + 1), stride):
                part = codes[at : at + window + stride - 1]
                rows.append((i, part, len(part) - window + 1, window))
            rest = codes[max(0, -(-(n - window) // stride)) * stride :] if n > window else codes
            if 0 < len(rest) < window and (n <= window or len(rest) > window - stride):
                rows.append((i, rest, 1, len(rest)))
        ints = lambda k: np.array([r[k] for r in rows], np.int64)
        return cls(ints(0), [r[1] for r in rows], ints(2), ints(3), np.maximum(1, np.ceil(share * ints(3) - 1e-9)).astype(np.int64))


def window_subsequences(a: np.ndarray, q: np.ndarray, offset: np.ndarray, theirs: np.ndarray, masks: np.ndarray | None, window: int) -> np.ndarray:
    """Longest common subsequence of each row of ``a`` and the window at ``offset`` of segment ``q``."""
    if masks is None:
        wide = np.pad(theirs, ((0, 0), (0, window)), constant_values=-2)
        return common_subsequences(a, wide[q[:, None], offset[:, None] + np.arange(window)])
    full, shift = np.uint64((1 << window) - 1), offset.astype(np.uint64)
    row = np.full(len(a), full)
    for i in range(a.shape[1]):
        hit = row & (masks[q, a[:, i]] >> shift)
        row = ((row + hit) | (row - hit)) & full
    return window - np.bitwise_count(row).astype(np.int32)


def _close(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Unit vectors of windows in latent space."""
    z = np.zeros((len(rows), table.shape[1]), np.float32)
    for j in range(rows.shape[1]):
        z += table[rows[:, j]]
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def _follow_op(batches: Iterator[pa.RecordBatch], items: Items, segments: Segments, table: np.ndarray, least_cosine: float, window: int, stride: int) -> Iterator[pa.RecordBatch]:
    """All windows of the passages against all windows of the items.

    A window that shares fewer tokens with a segment, or a shorter common subsequence, than the segment's
    windows need cannot follow one of them, so both tests before the last leave out nothing.
    """
    terms, width = len(items.vocabulary), window + stride - 1
    answers = [set(a.tolist()) for a in items.answers]
    ids = np.array(items.ids, np.int64)
    lengths = np.array([len(c) for c in segments.codes])
    theirs = padded(np.concatenate(segments.codes), lengths, width, -2)
    masks = place_masks(theirs, terms)
    holds = np.zeros((terms + 1, len(lengths)), np.uint8)
    holds[np.concatenate(segments.codes), np.repeat(np.arange(len(lengths)), lengths)] = 1
    wide = np.pad(np.where(theirs < 0, terms, theirs), ((0, 0), (0, window)), constant_values=terms)
    index = [_close(wide[:, u : u + window], table) for u in range(segments.offsets.max())]
    # whole windows meet all segments, shorter ones those whose only window is as short
    kinds = [(window, np.arange(len(lengths)))] + [(int(w), np.flatnonzero(segments.span == w)) for w in np.unique(segments.span) if w < window]
    need = segments.need.astype(np.uint8)

    def found(mine: np.ndarray, size: np.ndarray, w: int, columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        held = holds[:, columns] if len(columns) < holds.shape[1] else holds
        count = np.zeros((len(mine), len(columns)), np.uint8)
        for j in range(w):
            count += held[mine[:, j]]
        last = np.maximum(1, size - (window - stride if w == window else w - 1))
        for j in range(width - w + 1):
            row, c = np.nonzero((count >= need[columns]) & (j < last)[:, None])
            if len(row):
                yield row, np.full(len(row), j), columns[c]
            if j + w < width:
                count += held[mine[:, j + w]]
                count -= held[mine[:, j]]

    for b in batches:
        lists = b.column(2)
        if not len(lists):
            continue
        doc, size = b.column(0).to_numpy(), lists.value_lengths().to_numpy()
        all_mine = padded(lists.flatten().to_numpy(), size, width, terms)
        for at in range(0, len(size), 1024):
            mine = all_mine[at : at + 1024]
            held: dict[tuple[int, int], list] = {}
            for w, columns in kinds:
                for row, j, q in found(mine, size[at : at + 1024], w, columns):
                    a = mine[row[:, None], j[:, None] + np.arange(w)]
                    a_codes = np.where(a == terms, -1, a)
                    ok = (masked_subsequences(a_codes, q, masks, width) if masks is not None else common_subsequences(a_codes, theirs[q])) >= segments.need[q]
                    a_codes, a, row, q = a_codes[ok], a[ok], row[ok], q[ok]
                    if not len(row):
                        continue
                    pair = np.repeat(np.arange(len(row)), segments.offsets[q])
                    u = np.arange(len(pair)) - np.repeat(np.cumsum(segments.offsets[q]) - segments.offsets[q], segments.offsets[q])
                    lcs = window_subsequences(a_codes[pair], q[pair], u, theirs, masks, window)
                    ok = lcs >= segments.need[q[pair]]
                    pair, u, lcs = pair[ok], u[ok], lcs[ok]
                    z = _close(a, table)
                    cosine = np.zeros(len(pair))
                    for k in np.unique(u):
                        cosine[u == k] = (z[pair[u == k]] * index[k][q[pair[u == k]]]).sum(axis=1)
                    ok = cosine >= least_cosine
                    pair, share = pair[ok], lcs[ok] / segments.span[q[pair[ok]]]
                    best = np.zeros(len(row))
                    np.maximum.at(best, pair, share)
                    for k in np.unique(pair).tolist():
                        i = int(segments.owner[q[k]])
                        told = bool(answers[i]) and answers[i] <= set(a[k].tolist())
                        old = held.setdefault((at + int(row[k]), i), [0.0, False])
                        old[0], old[1] = max(old[0], best[k]), old[1] or told
            if held:
                rows, owners = np.array(list(held), np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(doc[rows], pa.int64()), pa.array(ids[owners]), pa.array([float(x) for x, _ in held.values()]), pa.array([y for _, y in held.values()], pa.bool_())], names=["doc_id", "item_id", "lcs_share", "answer"])


def paraphrases(documents: DataFrame, items: DataFrame, window: int = 24, share: float = 0.7, least_cosine: float = 0.75, item_block: int = FOLLOW_BLOCK) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer): passages that follow an item's passage without copying it.

    Every window of ``window`` tokens of a document is compared with every such window of an item, wherever
    they begin; an item shorter than that is one window, met by windows of its own length too. The exact test
    by common subsequence comes first, then the cosine in latent space, so no candidate is lost between.
    """
    scratch = Scratch(documents.sparkSession, "paraphrases")
    stride = max(1, window // 2)
    out: DataFrame | None = None
    for k, block in enumerate(_blocks(items, item_block)):
        segments = Segments.of(block, window, stride, share)
        if not len(segments.owner):
            continue
        reached, idf = _passages(documents, block, Passages(window, stride, 0, int(segments.need.min()), stride - 1), scratch, f"passages{k}")
        known = F.size(F.filter("codes", lambda c: c >= 0))
        basis = latent_basis(reached.select(F.slice("codes", 1, window).alias("codes")).where(known >= min(window // 2, int(segments.need.min()))), idf, RANK)
        table = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
        found = reached.mapInArrow(lambda it, a=(block, segments, table, least_cosine, window, stride): _follow_op(it, *a), "doc_id bigint, item_id bigint, lcs_share double, answer boolean")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, lcs_share double, answer boolean")
    return out.groupBy("doc_id", "item_id").agg(F.max("lcs_share").alias("lcs_share"), F.max("answer").alias("answer"))
