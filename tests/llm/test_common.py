from __future__ import annotations

import os
import time

import pytest

from tidemark.llm import common


def test_release_deletes_what_is_not_read_any_more(spark):
    before = common.written()
    a, b = (common.stored(spark.range(5), n) for n in ("release-a", "release-b"))
    paths = [p for p in common._handed_out[before:]]
    assert common.release(spark, b, since=before) == 1
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True]
    assert b.count() == 5 and common.written() == before + 1


def test_discard_deletes_the_tables_given(spark):
    before = common.written()
    a, b, c = (common.stored(spark.range(5), n) for n in ("discard-a", "discard-b", "discard-c"))
    paths = common._handed_out[before:]
    assert common.discard(a, b) == 2 and common.written() == before + 1
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, False, True] and c.count() == 5


def test_shuffle_files_go_once_a_table_is_stored(spark):
    tracked = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, setting = tracked(), spark.conf.get(common._CLEANUP)
    common.stored(spark.range(1000).repartition(7), "shuffled")
    for _ in range(50):
        if tracked() <= before:
            break
        time.sleep(0.1)
    assert tracked() <= before and spark.conf.get(common._CLEANUP) == setting


def test_fresh_and_shield(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A_ int, _op_x int")
    assert common.fresh(df, "a", "b", "b") == ["a__", "b", "b_"]
    away, back = common.shield(df, "_op_")
    assert "_op_x" not in away.columns and away.withColumnsRenamed(back).columns == df.columns


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        common.scratch_dir(Session())
