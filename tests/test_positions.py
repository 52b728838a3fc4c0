"""Readers at positions beyond 32 bits, which tables six times the largest given ones have."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

IDS = [600_000, 600_001, 600_002]
#: query -> its column of positions
NAMES = {
    "read_baf_segmented": "pos",
    "read_gc_covariates": "pos",
    "read_genotype_input": "pos",
    "read_haplotypes": "pos",
    "read_phased_vcf": "pos",
    "read_region_manifest": "end",
    "read_replication": "pos",
    "read_track": "pos",
    "union_chromosome_files": "pos",
    "union_region_files": "pos",
}


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("far"))
    pd.DataFrame({"event_id": IDS, "user_id": 0, "value": 50.0}).to_parquet(os.path.join(folder, "events.parquet"))
    pd.DataFrame({"l_orderkey": [1]}).to_parquet(os.path.join(folder, "lineitem.parquet"))
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_far_positions(spark, far, name):
    got = entry.queries()[name](spark, far).toPandas()[NAMES[name]].tolist()
    assert sorted(got) == [5000 * i for i in (IDS[-1:] if name == "read_region_manifest" else IDS)]


def test_a_region_is_one_file(spark, tmp_path):
    """Each task wrote a file of its own for every region that it held."""
    folder = str(tmp_path)
    spark.range(4000).selectExpr("id as event_id", "id as user_id", "50.0 as value").repartition(4).write.parquet(os.path.join(folder, "events.parquet"))
    pd.DataFrame({"l_orderkey": [1]}).to_parquet(os.path.join(folder, "lineitem.parquet"))
    read = entry.queries()["union_region_files"](spark, folder)
    assert len(read.inputFiles()) == 4 and read.count() == 4000
