"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest

from latticelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(norm(r[i]) for i in at)) for r in cur.fetchall())


def test_shuffle_is_numpys(spark):
    got = sorted((r["batch_id"], r["pos_in_batch"], r["frame_index"]) for r in catalog.batch_shuffle(spark, SF).collect())
    n = len(got)
    assert [g[2] for g in got] == np.random.default_rng(7).permutation(np.arange(n)).tolist()


def test_the_rest_stands_without_the_llm_folder():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import) .*llm", f.read_text(), re.M), f
