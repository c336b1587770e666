"""Nodes that exchange records: pushes of fresh rows, bounded pulls, forced rounds, links that can be cut."""

from __future__ import annotations

import random
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.operators import version_vectors as vv
from mnemolake.session import Scratch
from mnemolake.sources.store import RecordStore

FANOUT = 3
EVENTS = "peer string, space string, pulled bigint, rounds int, error string"


@dataclass
class Mesh:
    """Record stores by node name. Every pair is linked unless cut; an offline node has no links."""

    spark: SparkSession
    stores: dict[str, RecordStore]
    seed: int = 0
    batch: int = vv.BATCH
    rounds: int = vv.ROUNDS
    cuts: set[frozenset[str]] = field(default_factory=set)
    queues: dict[str, list[DataFrame]] = field(default_factory=dict)
    facts: dict[tuple[str, str], dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._random = random.Random(self.seed)

    def cut(self, a: str, b: str) -> None:
        self.cuts.add(frozenset((a, b)))

    def heal(self, a: str | None = None, b: str | None = None) -> None:
        """Mend one link, or all."""
        self.cuts = self.cuts - {frozenset((a, b))} if a and b else set()

    def online(self, node: str) -> list[str]:
        return [p for p in sorted(self.stores) if p != node and frozenset((node, p)) not in self.cuts]

    def write(self, node: str, rows: DataFrame) -> int:
        """Store fresh rows at a node and queue them for its peers; the number that were new."""
        fresh = self.stores[node].accept(rows)
        n = fresh.count()
        if n:
            self.queues.setdefault(node, []).append(fresh)
        return n

    def queued(self, node: str) -> int:
        return sum(q.count() for q in self.queues.get(node, []))

    def push(self, node: str, fanout: int = FANOUT) -> list[str]:
        """Deliver the queue to ``fanout`` peers at most, chosen at random; the peers reached.

        With nobody online the queue stays. Otherwise it is spent, whatever the peers make of it: pulls
        deliver the rest.
        """
        waiting, online = self.queues.get(node, []), self.online(node)
        if not waiting or not online:
            return []
        self.queues[node] = []
        targets = online if len(online) <= fanout else self._random.sample(online, fanout)
        for peer in targets:
            for rows in waiting:
                self.stores[peer].append(rows)
        return sorted(targets)

    def pull(self, node: str, peer: str, space: str | None = None) -> tuple[int, int]:
        """Rounds of at most ``batch`` records a space until nothing is missing; records gained, and rounds."""
        mine, theirs = self.stores[node], self.stores[peer]
        if not theirs.exists():
            return 0, 0
        source = theirs.read() if space is None else theirs.read().where(F.col("space") == space)
        scratch = Scratch(self.spark, "pull")
        marks = scratch.write(vv.version_vector(source), "theirs")
        have = mine.read() if mine.exists() else source.limit(0)
        known, gained = scratch.write(vv.version_vector(have), "marks"), 0
        for k in range(self.rounds):
            got = scratch.write(vv.delta_limited(source, vv.missing_ranges(known, marks), self.batch), f"batch{k}")
            if got.isEmpty():
                break
            gained += mine.append(got).count()
            known = scratch.write(vv.merge(known, vv.version_vector(got)), f"marks{k}")
        else:
            k = self.rounds
        self.facts[node, peer] = {"last_contact": time.time(), "marks": marks}
        return gained, k

    def sync_now(self, node: str, only: str | None = None, space: str | None = None) -> DataFrame:
        """A forced round as a report: push first, then a pull from each peer, limited to one peer or one space.

        One row a peer: records gained and rounds, or why there was none.
        """
        if only is not None and only not in self.stores:
            raise KeyError(f"no such peer: {only}")
        self.push(node)
        rows, online = [], self.online(node)
        for peer in sorted(self.stores):
            if peer == node or only not in (None, peer):
                continue
            if peer not in online:
                rows.append((peer, space, 0, 0, "offline"))
                continue
            gained, k = self.pull(node, peer, space)
            rows.append((peer, space, gained, k, None))
        return self.spark.createDataFrame(rows, EVENTS)

    def lag(self, node: str) -> DataFrame:
        """peer, lag_behind, lag_ahead: marks in which each peer led or trailed when last heard."""
        out = self.spark.createDataFrame([], "peer string, lag_behind bigint, lag_ahead bigint")
        for (who, peer), fact in sorted(self.facts.items()):
            if who == node:
                out = out.unionByName(vv.lag(vv.version_vector(self.stores[node].read()), fact["marks"]).withColumn("peer", F.lit(peer)))
        return out
