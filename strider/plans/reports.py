"""Queries of noise floors, reports and rankings over lines as measurements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.operators import noise, report, stats
from strider.sources import tables

METRICS = ("price", "quantity", "discount", "none")
_COLUMNS = {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount"}


def _measured(spark: SparkSession, d: str, parity: int) -> DataFrame:
    """(key, values): means of the lines of an order with odd or even numbers; a discount of 0 is no value."""
    rows = tables.table(spark, d, "lineitem").where(F.col("l_linenumber") % 2 == parity).groupBy("l_orderkey").agg(*[F.avg(c).cast("double").alias(m) for m, c in _COLUMNS.items()])
    rows = rows.withColumn("discount", F.when(F.col("discount") > 0, F.col("discount")))
    return rows.select(F.col("l_orderkey").cast("long").alias("path"), F.create_map(*[x for m in _COLUMNS for x in (F.lit(m), F.col(m))]).alias("values"))


def _episode():
    return F.concat(F.lit("ep"), (F.col("path") * 7).cast("string"))


def null_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Odd lines of an order are its first measurement, even ones the second, of each eleventh at another setting than its own."""
    first = _measured(spark, d, 1).withColumn("episode", _episode())
    again = _measured(spark, d, 0).withColumn("setting", noise.setting(_episode()) + F.when(F.col("path") % 11 == 0, 1).otherwise(0))
    return noise.pairs(first, again, METRICS)


def floor_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = null_pairs(spark, d)
    return rows.select("path", "episode", "setting", "metric", *[F.round(c, 5).alias(c) for c in ("first", "again", "delta")])


def floors(spark: SparkSession, d: str) -> DataFrame:
    rows = noise.floors(null_pairs(spark, d))
    return rows.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def _taxes(spark: SparkSession, d: str) -> DataFrame:
    """(method, metric, tax): the mean paired delta of three measures, and of one without a floor."""
    parts = [stats.paired_deltas(tables.scores(spark, d, c)).groupBy("method").agg(F.avg("delta").alias("tax")).withColumn("metric", F.lit(m)) for m, c in (*_COLUMNS.items(), ("none", "l_tax"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def judged(spark: SparkSession, d: str) -> DataFrame:
    rows = noise.judged(_taxes(spark, d), noise.floors(null_pairs(spark, d)))
    return rows.select("method", "metric", F.round("tax", 5).alias("tax"), F.round("noise_floor", 5).alias("noise_floor"), F.round("noise_units", 5).alias("noise_units"), "below_floor")


def unmeasured(spark: SparkSession, d: str) -> DataFrame:
    clips = tables.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("path")).withColumn("episode", _episode())
    done = tables.table(spark, d, "lineitem").where("l_linenumber % 2 = 0").select(F.col("l_orderkey").cast("long").alias("path")).distinct().withColumn("setting", noise.setting(_episode()))
    return noise.unmeasured(clips, done).select("path", "episode", "setting")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    """(method, metric, n, median, warning) of suppliers' discounts by return flag."""
    deltas = stats.paired_deltas(tables.scores(spark, d, "l_discount"))
    return deltas.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 9).alias("median")).select("method", F.lit("discount|tax").alias("metric"), "n", "median", F.when(F.col("method") == "A", "<few> & far").alias("warning"))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    lines = report.markdown(spark, _summary(spark, d), about="of discounts")
    return lines.where("place = 1 or part = 0").select("part", "place", "text")


def html(spark: SparkSession, d: str) -> DataFrame:
    return report.html(spark, _summary(spark, d), about="a & b").where("part = 0").select("part", "place", "text")


def rank_unpaired(spark: SparkSession, d: str) -> DataFrame:
    rows = report.ranked(report.unpaired(tables.scores(spark, d, "l_quantity"), ["A", "R"]), "value", "higher_better")
    return rows.select("rank", "method", "episode", "role", F.round("value", 5).alias("value"))


def rank_lines(spark: SparkSession, d: str) -> DataFrame:
    """The 30 worst paired suppliers as a table of text."""
    rows = report.ranked(report.paired(tables.scores(spark, d, "l_discount")), "delta", "lower_better", top=30)
    return report.rendered(rows.withColumn("delta", F.round("delta", 7)), ["rank", "method", "episode", "delta"])


QUERIES = {
    "noise_floor_pairs": floor_pairs, "noise_floor_build": floors, "noise_floor_judged": judged, "noise_floor_unmeasured": unmeasured,
    "report_markdown": markdown, "report_html": html, "rank_unpaired": rank_unpaired, "rank_lines": rank_lines,
}

_N = f"""m AS (SELECT l_orderkey::BIGINT AS path, l_linenumber % 2 AS odd, avg(l_extendedprice)::DOUBLE AS price, avg(l_quantity)::DOUBLE AS quantity, avg(l_discount)::DOUBLE AS discount FROM lineitem GROUP BY ALL),
u AS (SELECT path, odd, unnest({list(METRICS)}) AS metric, unnest([price, quantity, CASE WHEN discount > 0 THEN discount END, NULL]) AS v FROM m),
np AS (SELECT a.path, 'ep' || a.path * 7 AS episode, ({noise.BASE} + a.path * 7 % {noise.SPAN})::INT AS setting, a.metric, a.v AS first, CASE WHEN a.path % 11 <> 0 THEN b.v END AS again FROM u a LEFT JOIN u b ON a.path = b.path AND a.metric = b.metric AND b.odd = 0 WHERE a.odd = 1),
fl AS (SELECT metric, count(again - first) AS n, avg(again - first) AS null_mean, median(again - first) AS null_median, stddev_pop(again - first) AS null_std, quantile_cont(abs(again - first), 0.95) AS null_p95, median(abs(again - first)) AS null_abs_median FROM np GROUP BY metric)"""


def _scores(c: str, i: int) -> str:
    return f"""s{i} AS (SELECT l_returnflag AS method, l_suppkey AS episode, CASE WHEN l_linestatus = 'F' THEN 'gt' ELSE 'pred' END AS role, avg({c}) AS value FROM lineitem GROUP BY ALL),
p{i} AS (SELECT g.method, g.episode, p.value - g.value AS delta FROM s{i} g JOIN s{i} p ON g.method = p.method AND g.episode = p.episode AND g.role = 'gt' AND p.role = 'pred')"""


_HEAD = "|".join(f" {h} " for h in report.SUMMARY_HEAD)
_SUM = f"{_scores('l_discount', 0)}, sm AS (SELECT method, count(*) AS n, round(avg(delta), 9) AS median FROM p0 GROUP BY method)"
_TH = "".join(f"<th>{h}</th>" for h in report.SUMMARY_HEAD)

SQL = {
    "noise_floor_pairs": f"WITH {_N} SELECT path, episode, setting, metric, round(first, 5) AS first, round(again, 5) AS again, round(again - first, 5) AS delta FROM np",
    "noise_floor_build": f"WITH {_N} SELECT metric, n, {', '.join(f'round({c}, 5) AS {c}' for c in ('null_mean', 'null_median', 'null_std', 'null_p95', 'null_abs_median'))} FROM fl",
    "noise_floor_judged": f"""WITH {_N}, {", ".join(_scores(c, i) for i, c in enumerate((*_COLUMNS.values(), "l_tax")))},
tx AS ({" UNION ALL ".join(f"SELECT method, '{m}' AS metric, avg(delta) AS tax FROM p{i} GROUP BY method" for i, m in enumerate(METRICS))})
SELECT method, metric, round(tax, 5) AS tax, round(null_p95, 5) AS noise_floor, round(CASE WHEN null_p95 <> 0 THEN abs(tax) / null_p95 END, 5) AS noise_units, NOT coalesce(null_p95 <> 0 AND abs(tax) / null_p95 >= 1, false) AS below_floor FROM tx LEFT JOIN fl USING (metric)""",
    "noise_floor_unmeasured": f"SELECT o_orderkey::BIGINT AS path, 'ep' || o_orderkey * 7 AS episode, ({noise.BASE} + o_orderkey * 7 % {noise.SPAN})::INT AS setting FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 0)",
    "report_markdown": f"""WITH {_SUM} SELECT 0 AS part, 1 AS place, '| ' || method || ' | discount\\|tax | ' || n || ' | ' || printf('%.4g', median) || ' | - | - | - | ' || CASE WHEN method = 'A' THEN '<few> & far' ELSE '' END || ' |' AS text FROM sm
UNION ALL SELECT 0, 0, unnest(['# Report', '', 'of discounts', '', '|{_HEAD}|', '|{"---|" * len(report.SUMMARY_HEAD)}'])""",
    "report_html": f"""WITH {_SUM} SELECT 0 AS part, 1 AS place, '<tr><td>' || method || '</td><td>discount|tax</td><td>' || n || '</td><td>' || printf('%.4g', median) || '</td><td>-</td><td>-</td><td>-</td><td>' || CASE WHEN method = 'A' THEN '&lt;few&gt; &amp; far' ELSE '' END || '</td></tr>' AS text FROM sm
UNION ALL SELECT 0, 0, unnest(['<!doctype html>', '<html><head><meta charset="utf-8"><title>Report</title></head><body>', '<p>a &amp; b</p>', '<table><caption>Report</caption><thead><tr>{_TH}</tr></thead><tbody>']) UNION ALL SELECT 0, 2, '</tbody></table>'""",
    "rank_unpaired": f"WITH {_scores('l_quantity', 0)} SELECT (row_number() OVER (ORDER BY value, method, episode, role))::INT AS rank, method, episode, role, round(value, 5) AS value FROM s0 WHERE method IN ('A', 'R') AND value IS NOT NULL",
    "rank_lines": f"""WITH {_scores('l_discount', 0)}, r AS (SELECT (row_number() OVER (ORDER BY delta DESC, method, episode))::INT AS rank, method, episode, round(delta, 7) AS delta FROM p0),
t AS (SELECT rank, rank::VARCHAR AS a, method AS b, episode::VARCHAR AS c, printf('%.6g', delta) AS d FROM r WHERE rank <= 30), w AS (SELECT greatest(4, coalesce(max(length(a)), 0)) AS wa, greatest(6, coalesce(max(length(b)), 0)) AS wb, greatest(7, coalesce(max(length(c)), 0)) AS wc, greatest(5, coalesce(max(length(d)), 0)) AS wd FROM t),
al AS (SELECT * FROM t UNION ALL SELECT 0, 'rank', 'method', 'episode', 'delta' UNION ALL SELECT 0, repeat('-', wa), repeat('-', wb), repeat('-', wc), repeat('-', wd) FROM w)
SELECT rank, rpad(a, wa::INT, ' ') || '  ' || rpad(b, wb::INT, ' ') || '  ' || rpad(c, wc::INT, ' ') || '  ' || rpad(d, wd::INT, ' ') AS text FROM al, w""",
}
