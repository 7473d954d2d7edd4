"""Queries against their SQL in DuckDB. The driver compares all of them; these are the quick ones and a few of each kind."""

from __future__ import annotations

import duckdb
import pytest

from cohortlake.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"
SLOW = [n for n in ORACLES if n.startswith(("attgt_", "agg_", "boot_", "diff_", "split_", "strata_", "influence_", "custom_"))]
CHOSEN = [n for n in ORACLES if n not in SLOW] + ["attgt_uncond", "attgt_rc_dr", "attgt_unbalanced_rc", "agg_event", "agg_cohort_overall", "diff_samples", "boot_band"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(str([round(v, 4) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)
    mine = plain(tuple(r[c] for c in columns) for r in got.collect())
    assert mine == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall()) and mine
