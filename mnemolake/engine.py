"""The read and write API over one record store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical_text
from mnemolake.operators import recall as _recall
from mnemolake.operators import reports, spaces
from mnemolake.operators.vector_index import VectorIndex, build_index
from mnemolake.operators.version_vectors import delta, version_vector
from mnemolake.operators.version_vectors import missing_ranges as _missing
from mnemolake.operators.write import Writer
from mnemolake.schema import RECORD
from mnemolake.sources.store import RecordStore, max_local_id


class Engine:
    """remember, recall, forget, link, get, list_spaces, sync and the reports, for one node."""

    def __init__(self, spark: SparkSession, path: str, node: str, agent: str, keys: DataFrame | None = None, peers: DataFrame | None = None) -> None:
        self.spark, self.store = spark, RecordStore(spark, path)
        self.keys = keys if keys is not None else spark.createDataFrame([], "space string, epoch bigint, is_current boolean")
        self.peers = peers if peers is not None else spark.createDataFrame([], "node string, enrolled boolean, address string, transport string, software string, embed_model string, last_contact timestamp_ntz, clock_skew_ms bigint, agent_keys array<string>, as_of timestamp_ntz")
        self.relaying: set[str] = set()
        self.writer = Writer(node, agent)
        self.index = VectorIndex(spark, f"{path}_index")
        self.warm = True
        if self.store.exists():
            self.writer.ids.seed(max_local_id(self.store.read(), node).first().max_id)
            self.warm = not self.index.cold(self.records)

    def warm_up(self) -> None:
        """Index what the kept index lacks; until then recall warns."""
        self.index.warm(self.records)
        self.warm = True

    @property
    def records(self) -> DataFrame:
        return self.store.read() if self.store.exists() else self.spark.createDataFrame([], RECORD)

    def _write(self, row: dict) -> str:
        row["received_at"] = dt.datetime.fromtimestamp(row["hlc"]["wall"] / 1000, dt.timezone.utc).replace(tzinfo=None)
        self.index.add(build_index(self.store.accept(self.spark.createDataFrame([row], RECORD))))
        return row["id"]

    def _context(self, space: str) -> dict[str, str]:
        return {r.node: r.high for r in version_vector(self.records.where(F.col("space") == space)).collect()}  # one row a node

    def _epoch(self, space: str) -> int:
        top = self.keys.where(F.col("space") == space).agg(F.max("epoch")).first()[0]
        if top is None:
            raise ValueError(f"space {space} is not readable")
        return top

    def create_space(self, space: str) -> None:
        self.keys = spaces.install(self.keys, space, 0)

    def rotate_space(self, space: str) -> None:
        self.keys = spaces.rotate(self.keys, space)

    def join_space(self, space: str, keys: DataFrame) -> None:
        """Take over a space's keys (space, epoch, ...) as another node shares them; a carried space becomes readable."""
        for r in keys.where(F.col("space") == space).select("epoch").distinct().collect():  # one row an epoch
            self.keys = spaces.install(self.keys, space, r.epoch)
        self.relaying.discard(space)

    def share_space(self, space: str) -> DataFrame:
        """The keys of a space, for another node to join it."""
        return self.keys.where(F.col("space") == space)

    def relay_space(self, space: str) -> None:
        """Carry a space for others without a key to it."""
        if not self.keys.where(F.col("space") == space).isEmpty():
            raise ValueError(f"space {space} is readable already")
        self.relaying.add(space)

    def accept_sealed(self, entries: DataFrame) -> int:
        """Take sealed entries of carried spaces, unread; the number that were new."""
        foreign = entries.select("space").distinct().where(~F.col("space").isin(sorted(self.relaying))).take(1)
        if foreign:
            raise ValueError(f"space {foreign[0].space} is not carried here")
        return self.store.accept_sealed(entries).count()

    def save_keys(self, path: str) -> None:
        """The keyring's epochs as JSON lines; key bytes stay outside of tables."""
        self.keys.coalesce(1).write.mode("overwrite").json(path)

    def load_keys(self, path: str) -> None:
        self.keys = self.spark.read.schema(self.keys.schema).json(path)

    def remember(self, space: str, body: str, **more: object) -> str:
        return self._write(self.writer.record(space, body, causal_ctx=self._context(space), epoch=self._epoch(space), **more))

    def _require(self, space: str, ids: list[str]) -> None:
        held = {r.id for r in self.records.where((F.col("space") == space) & F.col("id").isin(*ids)).select("id").collect()}  # one row an id at most
        if missing := set(ids) - held:
            raise KeyError(f"no such record: {', '.join(sorted(missing))}")

    def forget(self, space: str, id: str, reason: str = "") -> str:
        id = canonical_text(id)
        self._require(space, [id])
        more = {"causal_ctx": self._context(space), "epoch": self._epoch(space)}
        return self._write(self.writer.retraction(space, id, reason, **more) if reason.strip() else self.writer.tombstone(space, id, **more))

    def link(self, space: str, ids: list[str], note: str = "") -> str:
        ids = [canonical_text(i) for i in ids]
        self._require(space, ids)
        return self._write(self.writer.link(space, ids, note, causal_ctx=self._context(space), epoch=self._epoch(space)))

    def recall(self, query: str, **more: object) -> DataFrame:
        return _recall.annotated(self.records, _recall.recall(self.records, query, index=self.index, **more))

    def recall_notes(self, query: str, **more: object) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Hits, warnings, and the asked spaces that could not be searched with the reason."""
        hits = self.recall(query, **more)
        asked = self.spark.createDataFrame([(s,) for s in dict.fromkeys(more.get("spaces") or ())], "space string") if more.get("spaces") else self.records.select("space").distinct()
        return hits, _recall.warnings(self.records, hits, warm=self.warm), _recall.skipped_spaces(asked, self.records, self.keys, self.index.read())

    def get(self, space: str, id: str) -> DataFrame:
        """One record as an annotated hit."""
        return _recall.annotated(self.records, _recall.get(self.records, space, id))

    def list_spaces(self) -> DataFrame:
        return spaces.list_spaces(self.records, self.keys)

    def sync(self, peer: RecordStore, space: str | None = None) -> int:
        """Pull everything beyond my marks from a peer's store; the number of records that were new."""
        theirs = peer.read() if space is None else peer.read().where(F.col("space") == space)
        got = delta(theirs, _missing(version_vector(self.records), version_vector(theirs)))
        fresh = self.store.append(got)
        self.index.add(build_index(fresh))
        return fresh.count()

    def health(self) -> DataFrame:
        return reports.health(self.records, self.peers, self.keys, index=self.index.read(), relaying=bool(self.relaying), warm=self.warm)

    def members(self) -> DataFrame:
        return reports.members(self.records, self.peers, self.writer.node)

    def status(self) -> DataFrame:
        return reports.status(self.records, self.peers, self.keys)

    def key_report(self) -> DataFrame:
        return spaces.key_report(self.keys)
