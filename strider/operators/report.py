"""Reports and rankings as lines of text: a row of a table is a line, so what is written is made where the rows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.operators import order
from strider.operators.stats import oriented, paired_deltas

#: Digits of a number in a report and in a ranking.
DIGITS, RANK_DIGITS = 4, 6
# The heads of the tables of a report.
SUMMARY_HEAD = ("method", "metric", "n", "median delta", "CI low", "CI high", "p", "warning")
SEPARATION_HEAD = (
    "method", "metric", "units", "n", "real median", "gen median", "delta median", "CI low", "CI high", "p", "p (Holm)", "cliff's delta",
    "frac worse", "separation", "verdict", "noise floor", "above noise", "cross-rate", "reason",
)
RANK_HEAD = ("method", "mean rank", "n axes", "per-axis rank", "per-axis extra cost vs baseline")
#: Lines of a report: the part of the report, 0 before, 1 in and 2 behind its rows, what a row is sorted by, and the text.
LINES = "part int, place int, by string, text string"


def shortest(x: Column, digits: int = DIGITS, missing: str = "-") -> Column:
    """A double in ``digits`` digits without trailing zeros, in powers of ten from 1e``digits`` on and below 1e-4; halves go away from zero; null is ``missing``."""
    told = F.format_string(f"%.{digits - 1}e", F.abs(x))
    power = F.split_part(told, F.lit("e"), F.lit(2)).cast("int")
    ds = F.replace(F.split_part(told, F.lit("e"), F.lit(1)), F.lit("."))
    bare = lambda s: F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)
    mantissa = bare(F.concat(F.substring(ds, 1, 1), F.lit("."), F.substring(ds, 2, digits)))
    science = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    big = F.concat(ds.substr(F.lit(1), power + 1), F.lit("."), ds.substr(power + 2, F.lit(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), ds)
    text = F.when((power < -4) | (power >= digits), F.when(F.length(F.regexp_extract(told, "e[+-]?([0-9]+)$", 1)) > 2, F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(science)).otherwise(bare(F.when(power >= 0, big).otherwise(small)))
    signed = F.concat(F.when(x < 0, "-").otherwise(""), text)
    odd = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNull(), missing).otherwise(F.coalesce(odd, signed))


def cell(df: DataFrame, name: str, digits: int = DIGITS) -> Column:
    """A column as a table shows it: doubles shortened, null as a dash, flags as True and False."""
    if name not in df.columns:
        return F.lit("-")
    kind = dict(df.dtypes)[name]
    if kind in ("double", "float"):
        return shortest(F.col(name).cast("double"), digits)
    return F.coalesce(F.initcap(F.col(name).cast("string")) if kind == "boolean" else F.col(name).cast("string"), F.lit("-"))


def rate_flag(row_comparable: Column) -> Column:
    """What a row says of other frame rates: nothing where its metric scales with the rate in a known way."""
    return F.when(row_comparable, "").otherwise("not comparable across frame rates")


def _axes(df: DataFrame, name: str, signed: bool) -> Column:
    value = lambda v: F.concat(F.when(v >= 0, "+").otherwise(""), shortest(v.cast("double"), DIGITS)) if signed else shortest(v.cast("double"), RANK_DIGITS)
    said = F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ", ")
    return F.coalesce(F.when(said != "", said), F.lit("-")) if name in df.columns else F.lit("-")


def _or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def tables(summary: DataFrame | None, separation: DataFrame | None, ranks: DataFrame | None) -> list[tuple[str, tuple[str, ...], DataFrame | None]]:
    """(heading, head, rows) of each table of a report; rows are (by, cells).

    ``summary``: (method, metric, n, median, lo, hi, p, warning), ``separation``: rows of the operator
    of that name, with ci_lo, ci_hi, p and p_holm where its tests are joined, ``ranks``: rows of the ranking of methods.
    """

    def rows(df: DataFrame | None, key: list[str], cells) -> DataFrame | None:
        if df is None:
            return None
        return df.select(F.concat_ws("\x00", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key if k in df.columns]).alias("by"), F.array(*cells(df)).alias("cells"))

    plain = lambda *names: (lambda df: [cell(df, n) for n in names])
    sep = plain("method", "metric", "units", "n", "real_median", "gen_median", "delta_median", "ci_lo", "ci_hi", "p", "p_holm", "cliffs_delta", "frac_worse", "separation", "verdict", "noise_floor", "above_noise")
    return [
        ("Report", SUMMARY_HEAD, rows(summary, ["method", "metric"], lambda df: [*plain("method", "metric", "n", "median", "lo", "hi", "p")(df), _or_empty(df, "warning")])),
        ("Separation (magnitude + AUROC per method/ruler)", SEPARATION_HEAD, rows(separation, ["method", "metric"], lambda df: [*sep(df), rate_flag(F.col("rate_comparable")), _or_empty(df, "reason")])),
        ("Ranking (mean rank across physical axes)", RANK_HEAD, rows(ranks, ["method"], lambda df: [*plain("method", "mean_rank", "n_axes")(df), _axes(df, "axis_ranks", False), _axes(df, "extra_cost", True)])),
    ]


def escaped(x: Column) -> Column:
    """A text as markup shows it."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def _fixed(spark: SparkSession, lines: list[tuple[int, int, str]]) -> DataFrame:
    return spark.createDataFrame([(part, place, f"{i:06d}", text) for i, (part, place, text) in enumerate(lines)], LINES)


def markdown(spark: SparkSession, summary: DataFrame | None = None, separation: DataFrame | None = None, ranks: DataFrame | None = None, about: str = "") -> DataFrame:
    """The lines (``LINES``) of a report in markdown; a bar within a cell is escaped."""
    fixed, out = [], []
    for part, (heading, head, rows) in enumerate(tables(summary, separation, ranks)):
        fixed += [(part, 0, x) for x in (*([f"# {heading}", "", about] if part == 0 else ["", f"## {heading}"]), "", f"| {' | '.join(head)} |", "|" + "---|" * len(head))]
        if rows is not None:
            text = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
            out.append(rows.select(F.lit(part).alias("part"), F.lit(1).alias("place"), "by", text.alias("text")))
    lines = _fixed(spark, fixed)
    for rows in out:
        lines = lines.unionByName(rows)
    return lines


def html(spark: SparkSession, summary: DataFrame | None = None, separation: DataFrame | None = None, ranks: DataFrame | None = None, about: str = "") -> DataFrame:
    """The lines (``LINES``) of a report in HTML; all that comes from data is escaped, and a table without rows says so."""
    said = about.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    found = tables(summary, separation, ranks)
    fixed = [(0, 0, x) for x in ("<!doctype html>", '<html><head><meta charset="utf-8"><title>Report</title></head><body>', f"<p>{said}</p>")]
    out = []
    for part, (heading, head, rows) in enumerate(found):
        cells = "".join(f"<th>{h.replace(chr(39), '&#x27;')}</th>" for h in head)
        fixed += [(part, 0, f"<table><caption>{heading}</caption><thead><tr>{cells}</tr></thead><tbody>")]
        if rows is not None:
            text = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), ""), F.lit("</tr>"))
            out.append(rows.select(F.lit(part).alias("part"), F.lit(1).alias("place"), "by", text.alias("text")))
        if rows is None or not rows.head(1):
            fixed.append((part, 0, f'<tr><td colspan="{len(head)}">no rows</td></tr>'))
        fixed.append((part, 2, "</tbody></table>"))
    lines = _fixed(spark, [*fixed, (len(found), 0, "</body></html>")])
    for rows in out:
        lines = lines.unionByName(rows)
    return lines


def write(lines: DataFrame, uri: str) -> None:
    """One text file of the lines in order: a report has a line for each method and metric."""
    lines.coalesce(1).sortWithinPartitions("part", "place", "by").select("text").write.mode("overwrite").text(uri)


def unpaired(scores: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """(method, episode, role, value) of the scores that have a value, of some methods or all."""
    rows = scores.where(F.col("value").isNotNull() & ~F.isnan("value")).select("method", "episode", "role", "value")
    return rows if methods is None else rows.where(F.col("method").isin(*methods))


def paired(scores: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """(method, episode, delta) of the paired scores, of some methods or all."""
    rows = paired_deltas(scores).select("method", "episode", "delta")
    return rows if methods is None else rows.where(F.col("method").isin(*methods))


def ranked(rows: DataFrame, value: str, direction: str, top: int | None = None) -> DataFrame:
    """``rows`` with ``rank``, 1 the worst by ``value``; ties by the other columns in order. ``top`` keeps the worst so many.

    Ranks are running sums over sorted ranges, so no task holds all rows.
    """
    ties = [c for c in rows.columns if c != value]
    keyed = rows.withColumn("__good", -oriented(F.col(value).cast("double"), F.lit(direction))).withColumn("__one", F.lit(1))
    if top is not None:
        keyed = keyed.orderBy("__good", *ties).limit(top)  # the report's own length
    out = order.running_sums(keyed, [], ["__good", *ties], {"rank": "__one"})
    return out.select((F.col("rank") + 1).cast("int").alias("rank"), *rows.columns)


def rendered(rows: DataFrame, columns: list[str], form: str = "table") -> DataFrame:
    """(rank, text): a line for each row of a ranking in the form table, csv or json, the head at rank 0; json has none.

    Columns of a table are as wide as their widest cell, which an aggregate finds.
    """
    spark = rows.sparkSession
    if form == "json":
        return rows.select("rank", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("text"))
    head = lambda text: spark.createDataFrame([(0, text)], "rank int, text string")
    if form == "csv":
        return head(",".join(columns)).unionByName(rows.select("rank", F.to_csv(F.struct(*columns)).alias("text")))
    if form != "table":
        raise ValueError(f"form {form!r} is none of table, csv and json")
    cells = rows.select("rank", *[cell(rows, c, RANK_DIGITS).alias(f"c{i}") for i, c in enumerate(columns)])
    widest = cells.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(f"c{i}")), F.lit(0))).alias(f"w{i}") for i, c in enumerate(columns)])
    line = lambda xs: F.concat_ws("  ", *[F.concat(x, F.repeat(F.lit(" "), F.col(f"w{i}") - F.length(x))) for i, x in enumerate(xs)])
    body = cells.crossJoin(F.broadcast(widest)).select("rank", line([F.col(f"c{i}") for i in range(len(columns))]).alias("text"))  # one row
    heads = widest.select(F.lit(0).alias("rank"), line([F.lit(c) for c in columns]).alias("text"))
    rules = widest.select(F.lit(0).alias("rank"), F.concat_ws("  ", *[F.repeat(F.lit("-"), F.col(f"w{i}")) for i in range(len(columns))]).alias("text"))
    return heads.unionByName(rules).unionByName(body)
