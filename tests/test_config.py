import pytest

from tessera.config import RunConfig


def test_settings_are_checked():
    assert RunConfig("d").steps(70) == 2 and RunConfig(use_shards=True, shard_dir="s").k == 20
    for bad in ({}, {"use_shards": True, "data_dir": "d"}, {"data_dir": "d", "batch_size": 0}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    with pytest.raises(ValueError, match="fill"):
        RunConfig("d").steps(31)
