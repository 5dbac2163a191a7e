"""Stored tables and their scopes."""

import os

import pytest

from trustloom.sources.store import scope, shared_dir, stored


def folders(spark):
    shared_dir(spark)  # sets the folder where it is unset
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {x for x in os.listdir(root) if x.startswith("trustloom-")}


def test_a_scope_removes_what_is_stored_within(spark):
    kept = stored(spark.range(5))
    before = folders(spark)
    with scope(spark):
        inner = stored(spark.range(3))
        with scope(spark):
            assert stored(inner).count() == 3 and len(folders(spark)) == len(before) + 2
        assert inner.count() == 3 and len(folders(spark)) == len(before) + 1
    assert folders(spark) == before and kept.count() == 5
    with pytest.raises(ZeroDivisionError):
        with scope(spark):
            stored(spark.range(3))
            1 / 0
    assert folders(spark) == before
