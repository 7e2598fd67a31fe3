"""Facts of events with ids above a million come from the chapters in which they stand."""

import os

import pytest
from pyspark.sql import functions as F

from skein.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)


def test_chapters_do_not_depend_on_the_size_of_ids(spark, tmp_path):
    """Ids greater by 3,360,000 (divisible by all that the queries take remainders of) leave every fact as it is."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.withColumn("event_id", F.col("event_id") + 3_360_000).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("state_transition_facts", "replay_state"):
        got, want = (sorted(map(repr, QUERIES[name](spark, at).collect())) for at in (str(tmp_path), FOLDER))
        assert got == want and want
