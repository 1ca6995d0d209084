"""Identities of files."""

import pytest

from tidemark.plans import cache


def test_sampled_identity(spark, tmp_path):
    made = {}

    def identity(name, data, mode="sample"):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{name}.bin").write_bytes(data)
        return cache.file_identity(spark, str(tmp_path / name), mode)

    data = bytearray(5 << 20)
    made["same"] = identity("a", data)
    assert identity("b", data) == made["same"] != identity("b", data, "content")  # a copy by another name is the same
    for at in (0, 5 << 19, (5 << 20) - 1):
        other = bytearray(data)
        other[at] = 1
        assert identity("c", other) != made["same"]
    between = bytearray(data)
    between[3 << 19] = 1  # outside the three places
    assert identity("d", between) == made["same"] and identity("e", data + b"x") != made["same"]
    with pytest.raises(ValueError):
        cache.file_identity(spark, str(tmp_path), "half")
