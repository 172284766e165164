"""Every query outside the training-data package over tables with nulls in all columns and repeated rows, and over empty ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlstone.plans.catalog import QUERIES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS = 60


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    out = {kind: str(tmp_path_factory.mktemp(kind)) for kind in ("nulls", "empty")}
    for name in NAMES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        some = df.limit(ROWS)
        holes = [F.when(F.pmod(F.xxhash64(*[F.col(x).cast("string") for x in df.columns], F.lit(k)), F.lit(5)) > 0, F.col(c)).alias(c) for k, c in enumerate(df.columns)]
        with_nulls = some.select(*holes)
        with_nulls.unionByName(with_nulls.limit(5)).coalesce(1).write.parquet(f"{out['nulls']}/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{out['empty']}/{name}.parquet")
    return out


@pytest.mark.parametrize("kind", ["nulls", "empty"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_fails(spark, folders, name, kind):
    QUERIES[name](spark, folders[kind]).collect()
