"""The results store on files, and exports."""

import csv

import pytest
from pyspark.sql import functions as F

from strider.operators import export
from strider.plans import results as plans
from strider.sources import results

DATA = "/root/testdata/sf0.001"


def test_store_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert results.read_results(spark, path).count() == 0
    rows = plans.scored(spark, DATA)
    results.append_results(rows.limit(20), path)
    results.append_results(results.failed(spark.createDataFrame([("p1", "e1")], "path string, episode string"), {"robot": "r", "suite_id": "other"}, ["x"], "error:E"), path)
    got = results.read_results(spark, path)
    assert got.count() == 21 and results.keys(got).count() == 21
    results.assert_uniform(got)
    one = results.metric_rows(got.where("run.suite_id = 'other'")).first()
    assert (one.metric, one.value, one.reason) == ("x", None, "error:E")
    results.append_results(results.failed(spark.createDataFrame([("p2", "e2")], "path string, episode string"), {"suite_id": "other"}, ["y"], "error:E"), path)
    with pytest.raises(ValueError, match="other"):
        results.assert_uniform(results.read_results(spark, path))
    results.truncate(spark, path)
    assert results.read_results(spark, path).count() == 0


def test_csv_files(spark, tmp_path):
    rows = plans.rows(spark, DATA)
    export.write_clips(rows, ["cost"], f"file://{tmp_path}/clips", "cost", "lower_better")
    read, sizes = 0, {}
    for f in (tmp_path / "clips").rglob("*.csv"):
        with f.open() as stream:
            own = list(csv.DictReader(stream))
        read += len(own)
        costs = [float(r["cost"]) for r in own if r["cost"]]
        assert costs == sorted(costs, reverse=True) and all(r["cost"] == "" for r in own[len(costs) :])
        sizes[f.parent.name] = sizes.get(f.parent.name, 0) + len(own)
    assert read == rows.count() and "group=_unmatched%2Fother%2Fplace" in sizes
    sums = export.summary(rows, ["cost"])
    export.write_summary(sums, f"file://{tmp_path}/summary")
    assert export.rates_differ(sums)
    said = spark.createDataFrame([(0.0,), (None,), (float("nan"),)], "v double").select(export.said(F.col("v")).alias("s")).collect()
    assert [r.s for r in said] == ["0.00000", "", ""]
