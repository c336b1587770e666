"""Rows for new records: remember, forget, link, conflict."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from mnemolake.functions.clock import advance
from mnemolake.functions.embed import MODEL
from mnemolake.functions.ids import ALPHABET


def ulid_text(millis: int, entropy: bytes) -> str:
    value = (millis << 80) | int.from_bytes(entropy, "big")
    return "".join(ALPHABET[(value >> (5 * k)) & 31] for k in range(25, -1, -1))


def ulid_value(text: str) -> int:
    value = 0
    for c in text.upper().translate(str.maketrans("OIL", "011")):
        value = value * 32 + ALPHABET.index(c)
    return value


@dataclass
class IdSource:
    """Ids that never go back: within a millisecond, or behind the last one, the 80-bit tail counts up."""

    last: int = 0

    def seed(self, text: str) -> None:
        self.last = max(self.last, ulid_value(text))

    def next(self, millis: int | None = None) -> str:
        millis = int(time.time() * 1000) if millis is None else millis
        fresh = (millis << 80) | int.from_bytes(os.urandom(10), "big")
        if millis <= self.last >> 80:
            if (self.last + 1) >> 80 != self.last >> 80:
                raise OverflowError("no id left in this millisecond")
            fresh = self.last + 1
        self.last = fresh
        return ulid_text(fresh >> 80, (fresh & ((1 << 80) - 1)).to_bytes(10, "big"))


@dataclass
class Writer:
    """Stamps drafts with id, clock, epoch and author, as one node's single writer."""

    node: str
    agent: str
    model: str = ""
    ids: IdSource = field(default_factory=IdSource)
    clock: tuple[int, int] = (0, 0)

    def record(self, space: str, body: str, *, kind: str = "episode", evidence: str = "asserted", tags: list[str] | None = None, supersedes: list[str] | None = None, refs: list[str] | None = None, causal_ctx: dict[str, str] | None = None, epoch: int = 0, millis: int | None = None) -> dict:
        if not body.strip() and not supersedes:
            raise ValueError("a record needs a body, unless it supersedes one")
        now = int(time.time() * 1000) if millis is None else millis
        self.clock = advance(self.clock, None, now)
        tidy = lambda x: sorted(set(x)) if x else None
        return {
            "id": self.ids.next(now), "space": space, "author_node": self.node, "author_agent": self.agent, "author_model": self.model, "hlc": {"wall": self.clock[0], "counter": self.clock[1]}, "epoch": epoch,
            "kind": kind, "body": body, "tags": tidy(tags), "supersedes": tidy(supersedes), "refs": tidy(refs), "causal_ctx": causal_ctx or None, "evidence": evidence, "embed_model": MODEL, "sig": None, "bytes": len(body.encode()), "received_at": None,
        }

    def tombstone(self, space: str, target: str, **more: object) -> dict:
        return self.record(space, "", kind="tombstone", supersedes=[target], **more)

    def retraction(self, space: str, target: str, reason: str, **more: object) -> dict:
        return self.record(space, reason, kind="retraction", supersedes=[target], **more)

    def link(self, space: str, ids: list[str], note: str = "", **more: object) -> dict:
        if len(set(ids)) < 2:
            raise ValueError("a link needs two records")
        return self.record(space, note or "related records", refs=ids, **more)

    def conflict(self, space: str, sides: list[str], body: str = "contradicting records", **more: object) -> dict:
        if len(set(sides)) < 2:
            raise ValueError("a conflict needs two sides")
        return self.record(space, body, kind="conflict", evidence="derived", refs=sides, **more)
