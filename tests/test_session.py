from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vitalgrid.session import materialize, scratch_path, shared_dir


def test_scratch_tables_go_to_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured
    assert scratch_path(spark, "x").startswith(f"{configured}/vitalgrid/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_materialize_keeps_rows_and_cuts_the_plan(spark, capsys):
    stored = materialize(spark.range(10).select("id", F.lit("a").alias("t")), "kept")
    stored.explain("simple")
    assert "Range" not in capsys.readouterr().out
    assert stored.agg(F.sum("id")).first()[0] == 45


def test_only_a_local_master_may_use_a_temporary_folder():
    class Session:
        def __init__(self, **conf):
            self.values = {k.replace("_", "."): v for k, v in conf.items()}
            self.conf = self

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    for master in ("local", "local[4]", "local[*]"):
        session = Session(spark_master=master)
        assert shared_dir(session) == session.get("spark.checkpoint.dir") != ""
    for conf in ({"spark_master": "local-cluster[2,1,1024]"}, {"spark_master": "yarn"}, {}):
        with pytest.raises(RuntimeError):
            shared_dir(Session(**conf))
