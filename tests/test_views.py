"""Camera layouts and clip specs, small cases."""

import math

import pytest
from pyspark.sql import functions as F

from strider.sources import views


def described(spark, *rows):
    return views.described(spark.createDataFrame([(f"l{i}", *r) for i, r in enumerate(rows)], views.LAYOUT)).orderBy("layout").collect()


def test_keys_and_problems(spark):
    got = described(
        spark, (1, None, None, "height", None, None), (3, ["x", "y", "z"], 64, "height", None, None), (2, None, None, "width", None, None), (2, ["x", "y"], 8, "width", 3, [2, 0]), (1, None, None, "height", 1, None),
        (0, None, None, "height", None, None), (2, ["x"], None, "height", None, None), (1, None, 0, "height", None, None), (1, None, None, "pile", None, None), (1, None, None, None, None, None), (1, None, None, "height", 0, None),
        (3, None, None, "grid2x2", None, None), (2, None, None, "width", 3, [1]), (2, None, None, "width", 3, [1, 1]), (2, None, None, "width", 3, [1, 3]), (2, None, None, "width", 3, None), (None, None, None, "height", None, None),
    )
    by = {int(r.layout[1:]): r for r in got}
    assert [by[i].key for i in range(5)] == ["1x?:unnamed", "3x64:x+y+z", "2x?:unnamed:width:2p:0,1", "2x8:x+y:width:3p:2,0", "1x?:unnamed:height:1p:0"]
    assert [by[i].is_subset for i in range(5)] == [False, False, False, True, False]
    assert [by[i].problem for i in range(5)] == [None] * 5
    assert [by[i].problem for i in range(5, 17)] == [
        "n_views is below 1", "1 names for 2 views", "tokens_per_view is below 1", "no packing pile", "no packing null", "n_panels is below 1", "a grid has four panels",
        "not one panel a view", "panels repeat", "no such panel", "panels are not chosen", "n_views is below 1",
    ]


def test_boxes(spark):
    layouts = spark.createDataFrame([("stack", 3, None, None, "height", None, None), ("row", 3, None, None, "width", None, None), ("grid", 4, None, None, "grid2x2", None, None), ("some", 2, ["c", "a"], None, "width", 3, [2, 0]), ("none", 0, None, None, "height", 0, None)], views.LAYOUT)
    frames = spark.createDataFrame([(1, "row", 960, 192, "x"), (2, "stack", 960, 192, "x"), (3, "grid", 640, 480, "x"), (4, "some", 960, 192, "x"), (5, "grid", 641, 480, "x"), (6, "row", 100, 50, "x"), (7, "lost", 1, 1, "x"), (8, None, 1, 1, "x"), (9, "row", None, 1, "x"), (10, "none", 9, 9, "x"), (11, "stack", 64, 96, "x"), (12, "stack", 0, 0, "x")], "clip int, layout string, width int, height int, problem string")
    said = {r.clip: r for r in views.fits(frames, layouts).collect()}
    assert {k: r.problem for k, r in said.items() if r.problem} == {
        2: "no camera's shape: 960x64", 5: "width 641 is not 2 panels", 6: "width 100 is not 3 panels", 7: "no layout lost", 8: "no layout null", 9: "no size", 10: "n_views is below 1", 12: "no size",
    }
    assert said[11].view_height == 32 and said[1].view_height is None and said[4].panel_width == 320
    boxes = {}
    for r in views.crops(frames, layouts).orderBy("clip", "view").collect():
        boxes.setdefault(r.clip, []).append((r.name, r.panel, r.top, r.bottom, r.left, r.right))
    assert boxes == {
        1: [(None, i, 0, 192, 320 * i, 320 * i + 320) for i in range(3)], 3: [(None, i, 240 * (i // 2), 240 * (i // 2) + 240, 320 * (i % 2), 320 * (i % 2) + 320) for i in range(4)],
        4: [("c", 2, 0, 192, 640, 960), ("a", 0, 0, 192, 0, 320)], 11: [(None, i, 32 * i, 32 * i + 32, 0, 64) for i in range(3)],
    }
    every = views.crops(frames.where("clip = 4"), layouts, every=True).orderBy("panel").collect()
    assert [(r.panel, r.view, r.name) for r in every] == [(0, 1, "a"), (1, None, None), (2, 0, "c")]
    assert views.crops(frames.limit(0), layouts).count() == 0


def test_tokens_and_readers(spark):
    layouts = spark.createDataFrame([("three", 3, None, 64, "height", None, None), ("two", 2, None, None, "width", None, None), ("one", 1, None, 64, "height", None, None)], views.LAYOUT)
    features = spark.createDataFrame([("three", 192), ("three", 64), ("two", 7), ("two", 8), ("lost", 1), ("one", None)], "layout string, n_tokens int")
    assert [r.problem for r in views.token_problems(features, layouts).collect()] == [None, "64 tokens, not 192", "7 tokens are no multiple of 2", None, "no layout lost", "no tokens"]
    clips = spark.createDataFrame([("three", 64, 192), ("one", 64, 64), ("three", 64, 191)], "layout string, width int, height int")
    assert [r.problem for r in views.reader_problems(clips, layouts, "three").collect()] == [None, "reader of 3 views, clip of 1", "height 191 is not 3 panels"]
    assert {r.problem for r in views.reader_problems(clips, layouts, "lost").collect()} == {"no layout lost"}


def test_specs(spark):
    rows = spark.createDataFrame([("a", 10.0, None, 20), ("b", None, 0.05, 7), ("c", 10.0, 0.2, 1), ("d", 0.0, None, 1), ("e", None, 30.0, 1), ("f", math.nan, None, 1), ("g", 10.0, None, -1), ("h", None, None, 1), ("i", -5.0, None, 1), ("j", math.inf, None, 1), ("k", 0.05, None, 1)], "path string, fps double, dt double, n_frames long")
    got = {r.path: r for r in views.specs(rows).collect()}
    assert (got["a"].dt, got["a"].duration_s, got["a"].stride, got["b"].fps) == (0.1, 2.0, 1, 20.0) and got["b"].duration_s == pytest.approx(0.35)
    assert [got[k].problem for k in "abcdefghijk"] == [None, None, "dt and fps disagree", "fps is no rate", "dt is a rate?", "fps is no rate", "no frames told", "fps is no rate", "fps is no rate", "fps is no rate", "dt is a rate?"]
    sound = views.specs(rows).where("path in ('a', 'b')")
    twice = views.subsampled(views.subsampled(sound, 2), 3).orderBy("path").collect()
    assert [(r.n_frames, r.stride) for r in twice] == [(4, 6), (2, 6)] and twice[0].fps * twice[0].dt == pytest.approx(1) and twice[0].dt == pytest.approx(0.6) and twice[0].duration_s == pytest.approx(2.4)
    assert [r.problem for r in views.subsampled(sound, F.when(F.col("path") == "a", 0)).orderBy("path").collect()] == ["factor is below 1", None]
    with pytest.raises(ValueError):
        views.subsampled(sound, 0)
    told = views.records(sound.withColumns({"layout": F.lit("l"), "width": F.lit(4), "height": F.lit(4)}), spark.createDataFrame([("l", 1, None, None, "height", None, None)], views.LAYOUT))
    assert told.columns == list(views.RECORD) and {r.view_layout for r in told.collect()} == {"1x?:unnamed"}
