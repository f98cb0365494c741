"""Shipped trees, placing plans, cards and manifests, small cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strider.plans import trees as plans
from strider.sources import clips, samples, trees

P = "tree/c/e0/output/multiview"


def listed(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def rows(spark, *paths, exclude=()):
    found = trees.found(listed(spark, *paths), plans.GENERATORS, plans.CLAIMS, "tree", list(exclude))
    return found, {(r.generator, r.iter, r.episode): (r.pred_path and r.pred_path.rsplit("/", 1)[-1], r.gt_path and r.gt_path.rsplit("/", 1)[-1]) for r in trees.episodes(found).collect()}


def test_shapes(spark):
    base = f"{P}/g0/makovian"
    found, got = rows(
        spark, f"{base}/episode_1/full_pred.mp4", f"{base}/episode_1/full_gt.mp4", f"{base}/episode_2/full_pred.mp4", f"{base}/other_3/full_pred.mp4", f"{base}/episode_4/deep/full_pred.mp4", f"{base}/episode_5/full_gt.mp4",
        f"{P}/g1/makovian/iter_10/episode_a.mp4", f"{P}/g1/makovian/iter_10/task/episode_b.v2.mp4", f"{P}/g1/makovian/iter_10/_tmp/episode_c.mp4", f"{P}/g1/makovian/iter_10/task/.episode_d.mp4", f"{P}/g1/makovian/iter_10/task/x.mp4", f"{P}/g1/makovian/episode_e.mp4",
        f"{P}/g2/makovian/iter_1/7_pred.mp4", f"{P}/g2/makovian/iter_1/7_gt.mp4", f"{P}/g2/makovian/iter_1/8_pred.mp4", f"{P}/g2/makovian/iter_1/episode_9/p.mp4", f"{P}/g2/makovian/iter_1/episode_9/g.mp4", f"{P}/g2/makovian/iter_1/episode_10/g.mp4",
    )
    assert got == {
        ("g0", None, "episode_1"): ("full_pred.mp4", "full_gt.mp4"), ("g1", "iter_10", "episode_a"): ("episode_a.mp4", None), ("g1", "iter_10", "task/episode_b.v2"): ("episode_b.v2.mp4", None),
        ("g2", "iter_1", "flat:7"): ("7_pred.mp4", "7_gt.mp4"), ("g2", "iter_1", "dir:9"): ("p.mp4", "g.mp4"),
    }
    assert {r.generator: (r.n_episodes, r.n_skipped) for r in trees.cells(found).collect()} == {"g0": (1, 1), "g1": (2, 0), "g2": (2, 1)}


def test_most_populated_iteration_and_ties(spark):
    g1 = lambda turn, *names: [f"{P}/g1/makovian/{turn}/{n}" for n in names]
    found, got = rows(spark, *g1("iter_2", "episode_a.mp4"), *g1("iter_1", "episode_a.mp4", "episode_b.mp4"), *g1("iter_9", "log.txt"), *g1("iteration_5", "episode_a.mp4"))
    assert set(got) == {("g1", "iter_1", "episode_a"), ("g1", "iter_1", "episode_b")}
    _, got = rows(spark, *g1("iter_000020", "episode_a.mp4"), *g1("iter_000010", "episode_b.mp4"))
    assert set(got) == {("g1", "iter_000020", "episode_a")}
    found, got = rows(spark, *g1("iter_3", "log.txt"))
    assert got == {} and [(r.iter, r.n_episodes) for r in trees.cells(found).collect()] == [("iter_3", 0)]
    _, got = rows(spark, *g1("iter_2", "episode_a.mp4", "episode_b.mp4"), *g1("iter_1", "episode_a.mp4"), exclude=["**/iter_2"])
    assert set(got) == {("g1", "iter_1", "episode_a")}


def test_placing_is_idempotent_and_tells_collisions(spark):
    found, _ = rows(spark, f"{P}/g1/makovian/iter_1/a/episode_1.mp4", f"{P}/g1/makovian/iter_1/a__episode_1.mp4", f"{P}/g1/makovian/iter_1/episode_a__episode_1.mp4")
    plan = trees.placing(trees.episodes(found))
    assert {r.target for r in plan.collect()} == {"c/r0/multiview/g1/makovian/episode_a__episode_1/pred.mp4"}
    assert [r.n for r in trees.collisions(plan).collect()] == [2]
    assert trees.unplaced(plan, plan).count() == 0 and trees.unplaced(plan, plan.limit(0)).count() == plan.count()


def test_cards_round_trip(spark):
    found, _ = rows(spark, f"{P}/g1/makovian/iter_1/episode_1.mp4", f"{P}/g0/makovian/episode_1/full_pred.mp4")
    cells = trees.cells(found)
    metadata = spark.createDataFrame([(f"{P}/g1/makovian/all_summary.json", '{"num_episodes": 4, "total_episodes": 9}'), (f"{P}/g1/makovian/iter_1/info.json", '{"total_episodes": "many"}'), (f"{P}/g0/makovian/info.json", "{")], "path string, text string")
    told = trees.declared(metadata, cells, "tree")
    assert {r.generator: r.n_declared for r in told.collect()} == {"g0": None, "g1": 4}
    cards = trees.cards(told, "tree")
    read, bad = trees.read_cards(cards.unionByName(spark.createDataFrame([("x/cell_card.json", "{"), ("y/cell_card.json", '{"cache": "c", "view": "v"}'), ("z/cell_card.json", "[1]"), ("n/cell_card.json", None)], "path string, text string")))
    assert {(r.generator, r.robot, r.embodiment, r.iter) for r in read.collect()} == {("g1", "r0", "e0", "iter_1"), ("g0", "r0", "e0", None)}
    assert {r.place[0]: r.problem for r in bad.collect()} == {"x": "unreadable", "y": "missing: robot, generator, horizon, embodiment", "z": "unreadable", "n": "unreadable"}
    card = json.loads(next(r.text for r in cards.collect() if "g1" in r.path))
    assert card["n_declared"] == 4 and card["source_path"] == f"{P}/g1/makovian/iter_1" and list(card)[:5] == list(trees.PLACED)


def test_specs_are_checked():
    good = plans.SPEC["generators"]["g1"]
    for change, said in (({"shape": "pile"}, "shape"), ({"width": 0}, "width"), ({"has_iter_level": 1}, "has_iter_level"), ({"fps": 10}, "one of fps"), ({"fps_by_robot": {}}, "empty"), ({"pred_glob": None}, "pred_glob"), ({"fps_tolerant": "no"}, "fps_tolerant")):
        with pytest.raises(ValueError, match=said):
            trees.parse_spec({"generators": {"g": good | change}})
    with pytest.raises(ValueError):
        trees.parse_spec({"generators": {"g": good}, "exclude_globs": "x"})
    assert plans.GENERATORS[1].fps_of("r2") == 10 and plans.GENERATORS[1].fps_of("r9") is None and plans.GENERATORS[0].fps_of("r9") == 10
    assert trees.parse_robots({"robots": {"a": {"embodiment": "e", "generators": ["g"]}, "b": {"embodiment": "e", "generators": ["g", "h"]}}}) == [("a", "e", "g"), ("b", "e", "h")]
    for bad in ({}, {"robots": {"a": {"embodiment": "e"}}}, {"robots": {"a": {"embodiment": "", "generators": ["g"]}}}, {"robots": {"a": {"embodiment": "e", "generators": []}}}):
        with pytest.raises(ValueError):
            trees.parse_robots(bad)


def test_listing_of_a_folder(spark, tmp_path):
    for name in ("c/e0/a.bin", "c/b.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        assert {(r.path, r.bytes) for r in trees.listing(spark, root).collect()} == {("c/e0/a.bin", 10), ("c/b.bin", 7)}
    assert {r.sha1 for r in clips.hashes(spark, str(tmp_path)).collect()} == {hashlib.sha1(n).hexdigest() for n in (b"c/e0/a.bin", b"c/b.bin")}


def test_timebase(spark):
    df = spark.createDataFrame([(29.97, 30.0), (29.97, 10.0), (None, 10.0), (12.0, None), (None, None)], "probed double, told double")
    of = lambda **kw: [(r.b.fps, r.b.dt_source, r.b.problem) for r in df.select(clips.timebase(F.col("probed"), F.col("told"), **kw).alias("b")).collect()]
    assert of() == [(30.0, "table", None), (None, "table", "table says 10.000, probed 29.970"), (None, "table", "rate given but none probed"), (12.0, "ffprobe", None), (None, "ffprobe", "no rate")]
    assert of(fps=12.0)[3] == (12.0, "fps_arg", None) and of(dt=0.1)[3][2] == "dt_arg says 10.000, probed 12.000"
    with pytest.raises(ValueError):
        clips.timebase(F.col("probed"), F.col("told"), fps=1.0, dt=1.0)


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_manifest_round_trip(spark, tmp_path, form):
    told = spark.createDataFrame([("m", "f", "e1", "gt", "a.mp4", "k", None, "v"), ("m", "f", "e1", "pred", "b.mp4", "k", 10.0, "v"), ("m", "f", "e2", "pred", "c.mp4", "l", None, "v"), ("m", "f", "e3", "pred", "lost.mp4", "n", None, "v")], clips.DISCOVERED)
    record = lambda w, frames, rate: json.dumps({"streams": [{"codec_name": "h264", "width": w, "height": 4, "nb_frames": frames, "r_frame_rate": rate}]})
    seen = clips.probes(spark.createDataFrame([("a.mp4", record(8, "30", "10/1")), ("b.mp4", record(8, "31", "10/1")), ("c.mp4", record(8, "0", "10/1"))], "path string, text string"))
    hashed = spark.createDataFrame([("a.mp4", "00ff")], "path string, sha1 string")
    rows = clips.build(told, seen, hashed)
    assert {(r.path, r.problem) for r in clips.skipped(told, seen).collect()} == {("c.mp4", "unusable stream"), ("lost.mp4", "not probed")}
    path = clips.save(rows, str(tmp_path / "out"), form, clips.pairing_summary(rows))
    assert clips.autodetect(spark, str(tmp_path / "out")) == path
    back = clips.load(spark, path)
    assert back.columns == list(clips.COLUMNS) and sorted(back.collect()) == sorted(rows.collect())
    assert [r.ok for r in spark.read.json(str(tmp_path / "out" / "pairing_report.json")).collect()] == [True]
    (tmp_path / "plain_manifest.json").write_text(json.dumps([dict.fromkeys(clips.COLUMNS) | {"path": "a"}, dict.fromkeys(clips.COLUMNS) | {"path": "b"}]))
    found = clips.autodetect(spark, str(tmp_path))
    assert found.endswith("plain_manifest.json") and {r.path for r in clips.load(spark, found).collect()} == {"a", "b"}
    next((tmp_path / "out" / f"bench_manifest.{form}" / "header").glob("part*")).write_text(json.dumps({"version": 9, "form": form}))
    for p in (tmp_path / "out" / f"bench_manifest.{form}" / "header").glob(".*crc"):
        p.unlink()
    with pytest.raises(ValueError, match="version 9"):
        clips.load(spark, path)
    (tmp_path / "empty").mkdir()
    assert clips.autodetect(spark, str(tmp_path / "empty"), required=False) is None
    with pytest.raises(FileNotFoundError):
        clips.autodetect(spark, str(tmp_path / "empty"))
    assert clips.build(told, seen, cap=1).count() == 1
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "odd.parquet"))
    with pytest.raises(ValueError, match="lacks method"):
        clips.load(spark, str(tmp_path / "odd.parquet"))


def test_frames_meet_their_rows(spark):
    frames = spark.createDataFrame([("a", f) for f in range(5)] + [("b", 0), ("lost", 0)], "episode string, frame int")
    logs = spark.createDataFrame([("a", r, float(r)) for r in range(8)] + [("b", 0, 9.0)], "episode string, row int, q double")
    got = {(r.episode, r.frame): (r.row, r.q) for r in samples.joined(frames, logs, 3).collect()}
    assert got == {("a", 0): (0, 0.0), ("a", 1): (3, 3.0), ("a", 2): (6, 6.0), ("a", 3): (7, 7.0), ("a", 4): (7, 7.0), ("b", 0): (0, 9.0)}
    with pytest.raises(ValueError):
        samples.joined(frames, logs, 0)
    names = spark.createDataFrame([(n,) for n in ("10", "b", "9", "a", "100")], "episode string")
    assert [r.episode for r in samples.limited(names, 4).collect()] == ["9", "10", "100", "a"] and samples.limited(names, 0).count() == 5
    rows = spark.createDataFrame([(s, k) for s in "xy" for k in range(50)] + [("z", 0)], "s string, k int")
    one, two, other = (sorted(tuple(r) for r in samples.drawn(rows.repartition(n), "s", 5, seed, ["k"]).collect()) for n, seed in ((2, 1), (7, 1), (2, 2)))
    assert one == two != other and len(one) == 11


def test_paths_are_matched_once(spark):
    """A file's place is worked out once, not again for each filter and glob, and the cells are known before files that declare counts read them."""
    files = listed(spark, f"{P}/g1/makovian/iter_1/episode_1.mp4", f"{P}/g1/makovian/iter_1/", f"{P}/g1/makovian/a//b", f"{P}/g0/full_pred.mp4", f"{P}//makovian/x.mp4", "tree/c/e0/out/multiview/g1/makovian/iter_1/episode_2.mp4", "tree/c/e0", "x/tree/c")
    found = trees.found(files, plans.GENERATORS, plans.CLAIMS, "tree", ["**/iter_3*", "tree/x"])
    said = trees.cells(found)._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("regexp_extract") < 10 and said.count("RLIKE") < 20 and "pred_path" not in said
    assert {(r.view, r.generator, r.horizon, r.rest) for r in trees._placed(files, "tree").collect()} == {("multiview", "g1", "makovian", "iter_1/episode_1.mp4"), ("multiview", "g1", "makovian", "iter_1/"), ("multiview", "g1", "makovian", "a//b"), ("multiview", "g0", "", "full_pred.mp4")}
    assert trees._placed(listed(spark, f"{P}/g0/makovian/"), "tree").select("horizon", "rest").first() == ("", "makovian/")
