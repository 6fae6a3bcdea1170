"""Log lines of large keys keep their order."""

import os

import pytest
from oracle import TABLES, compare, duck

import __spark_entry__ as entry

#: Positions are a thousand times the key; the last keys of the copy are past 2^33 positions.
SHIFT = (1 << 33) // 1000 - 700


@pytest.fixture(scope="module")
def late_dir(sf_dir, tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("late")), duck(sf_dir)
    for name in TABLES:
        moved = {"orders": f"replace (o_orderkey + {SHIFT} as o_orderkey)", "lineitem": f"replace (l_orderkey + {SHIFT} as l_orderkey)"}.get(name, "")
        if moved:
            con.execute(f"copy (select * {moved} from {name}) to '{folder}/{name}.parquet' (format parquet)")
        else:
            os.symlink(f"{sf_dir}/{name}.parquet", f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["log_jobs", "log_recommendations"])
def test_positions_past_the_rows_of_a_scan(spark, late_dir, name):
    ok, message, _ = compare(spark, duck(late_dir), late_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
