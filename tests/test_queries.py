"""Every registered query with SQL against that SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load():
    import importlib

    for name in registry.MODULES:
        importlib.import_module(f"sparkloom.plans.{name}")


load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, (float, np.floating)) and np.isnan(x):
        return None
    if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, bool):
        return round(float(x), 5)
    return str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    """No SQL holds these; they give rows, the same at every run."""
    first, again = (rows(registry.QUERIES[name](spark, SF).toPandas()) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_tells_missing_modules(monkeypatch):
    """Without the training-data subpackage its queries are left out; any other missing module is an error."""
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def without(lacking):
        def load(name, *args, **kwargs):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {lacking!r}", name=lacking)
            return real(name, *args, **kwargs)

        return load

    for lacking in ("corpus_pipeline", "sparkloom.llm", "sparkloom.llm.queries"):
        monkeypatch.setattr(builtins, "__import__", without(lacking))
        assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    monkeypatch.setattr(builtins, "__import__", without("xxhash"))
    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        __spark_entry__.queries()
