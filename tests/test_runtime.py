"""Tables in the shared folder and their removal."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.runtime import discard, release, scratch, stored


def place(frame):
    return Path(frame._stored_at.removeprefix("file://"))


def test_discarded_tables_are_gone(spark):
    table = stored(spark.range(10), "some")
    assert place(table).exists() and table.count() == 10
    discard(table)
    assert not place(table).exists()


def test_release_spares_what_is_read_and_what_others_own(spark):
    with scratch("one"):
        first, second = stored(spark.range(3), "first"), stored(spark.range(4), "second")
    with scratch("two"):
        third = stored(spark.range(5), "third")
    fourth = stored(spark.range(6), "fourth")
    release("one", second.where("id > 0"))
    assert [place(t).exists() for t in (first, second, third, fourth)] == [False, True, True, True]
    release("one", fourth)
    assert not place(second).exists() and third.count() == 5


def test_shuffle_files_go_with_their_query_and_the_setting_stays(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = stored(sums, "sums")
    assert spark.conf.get(name, None) == before
    # the frame itself can still be computed, and its table read
    assert sums.count() == table.count() == 7
    with pytest.raises(Exception):
        stored(spark.range(3).select(F.raise_error(F.lit("no"))), "bad")
    assert spark.conf.get(name, None) == before
