import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from mnemolake.session import local_session

    s = local_session("tests", cores="4", partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Records from short dicts; everything left out takes a plain value, extra keys become extra columns."""
    import datetime as dt

    from mnemolake.schema import RECORD

    def build(rows, schema=RECORD):
        full = []
        for i, r in enumerate(rows):
            at = r.get("at", i)
            full.append(
                {
                    "id": f"01K4ZNE2F161394JJ04ZRK{i:04d}", "space": "shared/s", "author_node": "n1", "author_agent": "ag_x", "author_model": "m", "hlc": {"wall": 1_757_700_000_000 + i, "counter": 0}, "epoch": 0, "kind": "fact",
                    "body": "b", "tags": None, "supersedes": None, "refs": None, "causal_ctx": None, "evidence": "asserted", "embed_model": "hashbag-v1-384", "sig": None, "bytes": 300, "received_at": None if at is None else dt.datetime(2025, 9, 12) + dt.timedelta(minutes=at),
                }
                | {k: v for k, v in r.items() if k != "at"}
            )
        return spark.createDataFrame(full, schema)

    return build
