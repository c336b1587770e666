"""Sizes, durations and lists as a person reads them; names of nodes and agents."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
BUCKETS = (256, 1024, 4096, 16384, 65536)
BUCKET_STEP = 65536
UNITS = ("KB", "MB", "GB", "TB", "PB")


def size_bucket(n: Column) -> Column:
    """Padded length of a payload of ``n`` bytes, header included."""
    out = F.ceil(n / BUCKET_STEP).cast("bigint") * BUCKET_STEP
    for b in reversed(BUCKETS):
        out = F.when(n <= b, F.lit(b).cast("bigint")).otherwise(out)
    return out


def varint_length(n: Column) -> Column:
    out = F.lit(1)
    for k in range(1, 9):
        out = out + F.when(n >= (1 << (7 * k)), 1).otherwise(0)
    return out


def padded_length(n: Column) -> Column:
    """Bucket of ``n`` data bytes with their transform byte and length prefix."""
    return size_bucket(n + 1 + varint_length(n))


@F.pandas_udf(T.BinaryType())
def _length_prefix(n: pd.Series) -> pd.Series:
    def one(v: int) -> bytes:
        out = bytearray()
        while v >= 0x80:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        return bytes([*out, v])

    return n.map(lambda v: None if pd.isna(v) else one(int(v)))


def pad(data: Column) -> Column:
    """A transform byte (0: as it is), the length as a varint, the data, and zero bytes up to the bucket."""
    n = F.octet_length(data)
    return F.rpad(F.concat(F.lit(b"\x00"), _length_prefix(n), data), padded_length(n).cast("int"), F.lit(b"\x00"))


@F.pandas_udf(T.BinaryType())
def _unpad(padded: pd.Series) -> pd.Series:
    def bucket(n: int) -> int:
        return next((b for b in BUCKETS if n <= b), -(-n // BUCKET_STEP) * BUCKET_STEP)

    def one(p: bytes | None) -> bytes | None:
        if p is None or len(p) < 2 or p[0] != 0:
            return None
        n = shift = 0
        at = 1
        while True:
            if at >= len(p) or shift > 56:
                return None
            n |= (p[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if p[at - 1] < 0x80:
                break
        minimal = at == 2 or p[at - 1] != 0
        fits = at + n <= len(p) and len(p) == bucket(at + n) and not any(p[at + n :])
        return bytes(p[at : at + n]) if minimal and fits else None

    return padded.map(one)


def unpad(padded: Column) -> Column:
    """The data of ``pad``; null where prefix, bucket or the zero bytes are not exactly those of ``pad``."""
    return _unpad(padded)


def human_bytes(n: Column) -> Column:
    out = F.lit(None).cast("string")
    for k in range(len(UNITS), 0, -1):
        out = F.when((n < 1024 ** (k + 1)) | F.lit(k == len(UNITS)), F.format_string(f"%.1f{UNITS[k - 1]}", F.bround(n / F.lit(float(1024**k)), 1))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n.isNotNull(), out)


def human_duration(s: Column) -> Column:
    part = lambda of, unit: (of.cast("bigint")).cast("string") if not unit else F.concat(of.cast("bigint").cast("string"), F.lit(unit))
    return (
        F.when(s < 0, "never")
        .when(s < 60, part(s, "s"))
        .when(s < 3600, F.concat(part(F.floor(s / 60), "m"), part(s % 60, "s")))
        .when(s < 86400, F.concat(part(F.floor(s / 3600), "h"), part(F.floor((s % 3600) / 60), "m")))
        .otherwise(F.concat(part(F.floor(s / 86400), "d"), part(F.floor((s % 86400) / 3600), "h")))
    )


def node_name(host: Column, dns: Column) -> Column:
    """A host as a node id: its name, else the first DNS label, other characters replaced."""
    return F.regexp_replace(F.coalesce(F.nullif(host, F.lit("")), F.split_part(dns, F.lit("."), F.lit(1))), "[^A-Za-z0-9._-]", "-")


def negotiate(offered: Column, supported: int = 1) -> Column:
    """The greatest version both sides speak; null where there is none."""
    return F.array_max(F.filter(offered, lambda v: (v >= 1) & (v <= supported)))


def fingerprint(agent: Column) -> Column:
    """First eight and last four characters of an agent id without its prefix."""
    bare = F.regexp_replace(agent, "^ag_", "")
    return F.concat(F.left(bare, F.lit(8)), F.lit("…"), F.right(bare, F.lit(4)))


def kind_list(counts: Column) -> Column:
    """A map of counts as ``kind:n`` in kind order, kinds without any left out; ``-`` where none is left."""
    parts = F.transform(F.filter(F.array_sort(F.map_entries(counts)), lambda e: e["value"] > 0), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("-")


def _base32(prefix: str):  # noqa: ANN202
    @F.pandas_udf(T.StringType())
    def encode(key: pd.Series) -> pd.Series:
        return key.map(lambda k: None if k is None else prefix + base64.b32encode(bytes(k)).decode().rstrip("=").lower())

    return encode


def agent_text(key: Column) -> Column:
    """A 32-byte public key as agent id text."""
    return _base32("ag_")(key)


def recipient_text(key: Column) -> Column:
    return _base32("rk_")(key)


@F.pandas_udf(T.BinaryType())
def _parse_key(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> bytes | None:
        if not t or t[:3] not in ("ag_", "rk_"):
            return None
        try:
            key = base64.b32decode(t[3:].upper() + "=" * (-len(t[3:]) % 8))
        except ValueError:
            return None
        return key if len(key) == 32 else None

    return text.map(one)


def parse_key(text: Column) -> Column:
    """Key bytes of agent or recipient text; null where it is neither."""
    return _parse_key(text)
