import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from gridmill.session import local

    s = local(4, "4g", 4)
    yield s
    s.stop()


def plain(value):
    """A value as both engines give it."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 9)
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object).where(frame[names].notna(), None)
    return names, sorted(repr([plain(v) for v in r]) for r in frame.values.tolist())


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con
