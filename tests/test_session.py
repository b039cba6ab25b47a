"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from wallscope.session import SCRATCH_SETTING, materialize, scratch_root


def session(**settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))


def test_the_setting_names_the_folder():
    assert scratch_root(session(**{SCRATCH_SETTING: "hdfs://nn/shared/", "spark.master": "yarn"})) == "hdfs://nn/shared"


def test_only_local_sessions_may_use_a_temporary_folder():
    local = session(**{"spark.master": "local[4]"})
    assert scratch_root(local) == scratch_root(local)
    with pytest.raises(ValueError):
        scratch_root(session(**{"spark.master": "yarn"}))


def test_materialized_tables_keep_rows_and_schema(spark):
    frame = spark.range(10).selectExpr("id", "CAST(NULL AS STRING) AS text")
    stored = materialize(frame, "numbers")
    assert sorted(stored.collect()) == sorted(frame.collect())
    assert stored.dtypes == frame.dtypes
