"""Views in Spark against the same text in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from acn.sources.views import view, with_views


@pytest.fixture(scope="module")
def four_rows_a_segment(tmp_path_factory):
    """Means of four values of five digits: a half of them lie halfway between two numbers of six digits."""
    rng = np.random.default_rng(3)
    stretch, chrom = np.divmod(np.arange(60 * 22 * 4), 22 * 4)
    events = pd.DataFrame({"event_id": stretch * 2500 + chrom, "user_id": chrom % 22, "value": np.round(rng.exponential(50, len(chrom)), 2)})
    path = tmp_path_factory.mktemp("halves")
    events.to_parquet(path / "events.parquet", index=False)
    pd.DataFrame({"l_orderkey": [1]}).to_parquet(path / "lineitem.parquet", index=False)
    return str(path)


@pytest.mark.parametrize("name", ["v_segments", "v_seg6", "v_baf_segmented"])
def test_halfway_means_are_rounded_alike(spark, four_rows_a_segment, name):
    """Spark's round() goes by the shortest decimal form, DuckDB's by the product with 10^6: 0.7014725, a bit short of it as a double, fell in one and rose in the other."""
    con = duckdb.connect()
    con.sql("set threads = 1")
    con.sql(f"create view events as select * from '{four_rows_a_segment}/events.parquet'")
    want = con.sql(with_views(f"select * from {name}", [name])).df()
    got = view(spark, four_rows_a_segment, name).toPandas()
    key = ["chrom", "pos"] if "pos" in want else ["seg_id"] if "seg_id" in want else ["chrom", "start_pos"]
    want, got = (df.sort_values(key).reset_index(drop=True) for df in (want, got))
    assert list(want.columns) == list(got.columns) and len(want) == len(got)
    for c in want.columns:
        assert (np.abs(want[c] - got[c]) < 1e-9).all() if want[c].dtype.kind == "f" else (want[c] == got[c]).all(), c
