"""Globs, filters and splits."""

import re

import pytest

from strider.sources import layout


def test_globs():
    cases = {
        "**/tmp/**": (["tmp", "a/tmp", "a/tmp/b/c"], ["tmpx", "a/tmpx/b"]),
        "*/b?.mp4": (["a/b1.mp4"], ["a/b.mp4", "a/c/b1.mp4", "b1.mp4"]),
        "a/**": (["a", "a/b", "a/b/c"], ["ab", "b/a"]),
        "x[?]y.**": (["x?y.z/w"], ["xay.z"]),
        "a+(b).mp4": (["a+(b).mp4"], ["aa(b).mp4"]),
    }
    for glob, (yes, no) in cases.items():
        pattern = re.compile(layout.glob_pattern(glob))
        assert all(pattern.match(p) for p in yes) and not any(pattern.match(p) for p in no)


def test_only():
    values = {"view": ["a", "b"], "robot": ["r"]}
    assert layout.parse_only(["view=a", "robot=r"], values) == [("view", "a"), ("robot", "r")]
    for bad in ("view", "view=c", "axis=a"):
        with pytest.raises(ValueError, match="AXIS=VALUE"):
            layout.parse_only([bad], values)


def test_scenes_stay_together(spark):
    names = [f"task{s}_{i:03d}" for s in range(20) for i in range(s + 1)] + ["17", "18"]
    rows = spark.createDataFrame([(n,) for n in names], "episode string")
    got = layout.scene_split(rows, 0.2).withColumn("scene", layout.scene(rows["episode"])).toPandas()
    assert len(got) == len(names) and (got.groupby("scene").split.nunique() == 1).all()
    assert 0.15 < (got.split == "val").mean() <= 0.2 and {"17", "18"} <= set(got[got.split == "val"].scene)
    one = layout.scene_split(spark.createDataFrame([("a_1",), ("a_2",), ("b_1",), ("b_2",)], "episode string"), 0.1).toPandas()
    assert (one.split == "val").sum() == 2
    with pytest.raises(ValueError, match="val_ratio"):
        layout.scene_split(rows, 1.0)
