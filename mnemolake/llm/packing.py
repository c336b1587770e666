"""Filling fixed-capacity training sequences: vector bin packing by the dot-product heuristic.

An example has three sizes, each limited in a container at the same time: tokens, segments (one each) and
loss-bearing tokens. A container is filled by taking, again and again, the example whose size vector has
the largest dot product with what room is left, among those that fit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_ROWS = 20_000
"""Pieces that one packing task takes, on average."""
REPACK_BELOW = 0.98
"""Containers filled less than this after the first round give their pieces to a second one."""


@dataclass(frozen=True)
class Limits:
    """What one container may hold. A loss limit below that of tokens leaves no container for a text of more
    loss-bearing tokens, which must stay whole; such a text has a container of its own."""

    tokens: int = 2048
    segments: int = 24
    loss: int = 2048


INSTRUCTION = Limits(2048, 12, 1792)
"""Limits of instruction data, all of which bind: a sequence keeps an eighth of its room for tokens without loss."""


@cache
def _encoding(vocabulary: str):  # noqa: ANN202
    """The tokenizer, and the number of bytes of each of its tokens."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def loss_bearing(text: str, tokens: np.ndarray, lengths: np.ndarray, heads: tuple[str, ...]) -> np.ndarray:
    """Whether each token begins outside the lines of masked roles."""
    if not heads or not any(h in text for h in heads):
        return np.ones(len(tokens), bool)
    lines = text.splitlines(True)
    ends = np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in lines])
    hidden = np.array([x.startswith(heads) for x in lines])
    starts = np.cumsum(lengths[tokens]) - lengths[tokens]
    return ~hidden[np.minimum(np.searchsorted(ends, starts, side="right"), len(lines) - 1)]


def _pieces_op(batches: Iterator[pa.RecordBatch], vocabulary: str, masked: tuple[str, ...], cap: int) -> Iterator[pa.RecordBatch]:
    """The pieces of whole texts, with the tokens and loss-bearing tokens of each; an empty text is one empty piece."""
    from pyspark import TaskContext

    encoding, lengths = _encoding(vocabulary)
    heads = tuple(f"{role}: " for role in masked)
    copy = TaskContext.get().partitionId() << 33  # numbers the rows, so that equal ids stay apart
    for b in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            copy += 1
            tokens = np.array(encoding.encode_ordinary(text), np.int64) if text else np.zeros(0, np.int64)
            bearing = np.concatenate([[0], np.cumsum(loss_bearing(text, tokens, lengths, heads))]) if text else np.zeros(1, np.int64)
            for piece, at in enumerate(range(0, max(1, len(tokens)), cap)):
                end = min(at + cap, len(tokens))
                rows.append((doc, copy, piece, end - at, int(bearing[end] - bearing[at])))
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "copy", "piece", "tokens", "loss"])


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """Container number of each piece. A piece that alone exceeds a limit has a container of its own.

    Pieces of equal sizes are one kind with a count, so a step costs the number of kinds, not of pieces.
    """
    n = len(tokens)
    box = np.full(n, -1, np.int64)
    cap = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    alone = (tokens > limits.tokens) | (loss > limits.loss)
    used = int(alone.sum())
    box[alone] = np.arange(used)
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return box
    kinds, kind_of = np.unique(np.stack([tokens[rest], loss[rest]], axis=1), axis=0, return_inverse=True)
    order = rest[np.argsort(kind_of.ravel(), kind="stable")]
    left = np.bincount(kind_of.ravel(), minlength=len(kinds))
    upto = np.cumsum(left)
    size = np.stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]], axis=1) / cap
    # largest first, so that the first of equal scores is the largest
    by = np.argsort(-kinds[:, 0], kind="stable")
    size, left, upto = size[by], left[by], upto[by]
    todo, eps = len(rest), 1e-9
    while todo:
        room = np.ones(3)
        alive = np.flatnonzero(left)
        if len(alive) < 0.7 * len(left):
            size, left, upto = size[alive], left[alive], upto[alive]
        while todo:
            score = np.where((left > 0) & (size <= room + eps).all(axis=1), size @ room, -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                break
            box[order[upto[k] - left[k]]] = used
            left[k] -= 1
            room = room - size[k]
            todo -= 1
        used += 1
    return box


def _pack_groups(batches: Iterator[pd.DataFrame], limits: Limits) -> Iterator[pd.DataFrame]:
    """The one group that the task holds."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True).sort_values(["doc_id", "copy", "piece"], ignore_index=True)
    out = pdf.assign(box=pack(pdf["tokens"].to_numpy(), pdf["loss"].to_numpy(), limits))
    yield out.assign(fill=out.groupby("box")["tokens"].transform("sum"))[["doc_id", "copy", "piece", "tokens", "loss", "grp", "box", "fill"]]


def pack_documents(documents: DataFrame, limits: Limits = Limits(), masked_roles: tuple[str, ...] = ("user", "tool"), vocabulary: str = VOCABULARY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The sequence of each text: doc_id, copy, piece, first_token, tokens, loss, seq_id.

    A text longer than ``limits.tokens`` is cut into full pieces and a rest; any other stays whole. Loss is
    the number of tokens of the piece that begin outside lines of ``masked_roles``. Pieces are dealt by hash
    into groups of about ``group_rows``, each packed by a task of its own; pieces of containers that were
    left short are dealt and packed again together, so the cuts between groups cost next to nothing.

    Defined cases: null and empty texts have no token and get a row with null seq_id; a piece over another
    limit than tokens has a container of its own; rows that repeat a doc_id are different copies, numbered;
    ties go to the smaller doc_id; null ids have no row; other columns are ignored; an empty table gives an
    empty result. ``vocabulary`` is a file that every worker can read.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    pieces = scratch.write(rows.mapInArrow(lambda it: _pieces_op(it, vocabulary, masked_roles, limits.tokens), "doc_id bigint, copy bigint, piece int, tokens bigint, loss bigint"), "pieces")
    whole = pieces.where((F.col("tokens") == limits.tokens) & (F.col("tokens") > 0))
    partial = pieces.where((F.col("tokens") > 0) & (F.col("tokens") < limits.tokens))
    schema = "doc_id bigint, copy bigint, piece int, tokens bigint, loss bigint, grp int, box bigint, fill bigint"

    def deal(some: DataFrame, name: str, first: int) -> tuple[DataFrame, int]:
        groups = max(1, -(-some.count() // group_rows))
        keyed = some.select("doc_id", "copy", "piece", "tokens", "loss", (F.pmod(F.xxhash64(F.lit(first), "doc_id", "copy", "piece"), F.lit(groups)).cast("int")).alias("grp"))
        op = lambda it: _pack_groups((b.assign(grp=b["grp"] + first) for b in it), limits)
        return scratch.write(keyed.repartitionById(groups, "grp").mapInPandas(op, schema), name), first + groups

    full = F.col("fill") >= REPACK_BELOW * limits.tokens
    packed, upto = deal(partial, "packed", 0)
    again, _ = deal(packed.where(~full), "again", upto)
    placed = packed.where(full).unionByName(again)
    place = lambda d, seq: d.select("doc_id", "copy", "piece", (F.col("piece") * limits.tokens).cast("bigint").alias("first_token"), "tokens", "loss", seq.alias("seq_id"))
    out = place(placed, F.concat_ws("-", F.lit("s"), "grp", "box")).unionByName(place(whole, F.concat_ws("-", F.lit("d"), "doc_id", "copy", "piece")))
    return out.unionByName(place(pieces.where(F.col("tokens") == 0), F.lit(None).cast("string")))


def packing_report(placed: DataFrame, limits: Limits) -> DataFrame:
    """One row: sequences, their fill and the least number the limits allow, and whatever breaks a promise.

    texts and empty_texts are counted as placed; over_tokens, over_segments and over_loss are sequences
    beyond a limit (of several pieces, for the last); split_texts are texts cut although they fit; broken_texts
    are texts whose pieces do not follow each other without gap or repeat.
    """
    seqs = placed.where(F.col("seq_id").isNotNull()).groupBy("seq_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"), F.sum("loss").alias("l"), F.sum(F.least(F.col("loss"), F.lit(limits.loss))).alias("bound"))
    a = seqs.agg(
        F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("bound"), F.lit(0)).alias("loss"), F.max("k").alias("most_segments"), F.count_if(F.col("k") == limits.segments).alias("full_segments"),
        F.count_if(F.col("l") == limits.loss).alias("full_loss"), F.count_if(F.col("n") > limits.tokens).alias("over_tokens"), F.count_if(F.col("k") > limits.segments).alias("over_segments"), F.count_if((F.col("l") > limits.loss) & (F.col("k") > 1)).alias("over_loss"),
    )
    texts = placed.groupBy("doc_id", "copy").agg(F.count("*").alias("k"), F.count_distinct("piece").alias("d"), F.max("piece").alias("last"), F.sum("tokens").alias("n"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.count("seq_id").alias("placed"))
    broken = (F.col("d") != F.col("k")) | (F.col("last") != F.col("k") - 1) | (F.col("n") != F.col("end")) | ((F.col("n") > 0) & (F.col("placed") < F.col("k")))
    b = texts.agg(F.count("*").alias("texts"), F.count_if(F.col("n") == 0).alias("empty_texts"), F.count_if((F.col("n") <= limits.tokens) & (F.col("k") > 1)).alias("split_texts"), F.count_if(broken).alias("broken_texts"))
    bound = F.greatest(*(F.ceil(F.col(c) / cap) for c, cap in (("tokens", limits.tokens), ("pieces", limits.segments), ("loss", limits.loss))))
    return a.select("*", bound.alias("least_sequences"), (F.col("tokens") / (F.col("sequences") * limits.tokens)).alias("fill"), *(b.select(c).scalar().alias(c) for c in b.columns))
