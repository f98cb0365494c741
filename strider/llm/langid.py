"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.llm.tables import written

UNKNOWN = "und"
#: Dimensions of byte n-grams of length 1, 2 and 3; the latter two are hashed.
DIMS = (256, 2048, 6144)
TOTAL = sum(DIMS)
CLUSTERS = 4
#: About so many different labelled texts of each language are clustered; document frequencies use them all.
SAMPLE = 1000
#: A cluster needs this share of its language's sample.
LEAST_SHARE = 0.05
#: Of the distances of clustered texts of a size to the nearest centroid; a text is rejected beyond the quantile plus the factor times its distance from the median.
QUANTILE, SLACK = 0.98, 0.5
#: Classes of the size of a text: the powers of the root of 2 of its letter bytes; those of fewer sampled pieces use the next.
SIZES, LEAST_PIECES = 32, 20
#: Labels up to which their sizes are broadcast.
MOST_LABELS = 10_000
#: Bytes profiled at a time.
BLOCK = 1 << 16

_SPACES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by its Unicode category, which is what ``\\p{L}`` says in Spark."""
    return bool(text) and any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    """Counts of the n-grams of the lower-cased letters of a text, words set apart by spaces."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()) + b" "
    out = np.zeros(TOTAL, np.float32)
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(data[at : at + BLOCK + 2], np.uint8).astype(np.int64)
        fresh = min(BLOCK, len(b))
        out[: DIMS[0]] += np.bincount(b[:fresh], minlength=DIMS[0])
        two = b[:-1] * 263 + b[1:]
        three = two[:-1] * 263 + b[2:]
        out[DIMS[0] : DIMS[0] + DIMS[1]] += np.bincount(two[:fresh] % DIMS[1], minlength=DIMS[1])
        out[DIMS[0] + DIMS[1] :] += np.bincount(three[:fresh] % DIMS[2], minlength=DIMS[2])
    out[32] = 0
    return out


def sized_vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1: (1 + log count) times idf, each n-gram length with the same share; and the class of each text's size."""
    x = np.stack([profile(t) for t in texts]) if texts else np.zeros((0, TOTAL), np.float32)
    size = (2 * np.log2(np.maximum(x[:, : DIMS[0]].sum(axis=1), 1))).astype(int).clip(0, SIZES - 1)
    np.log1p(x, out=x)
    x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), size


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    return sized_vectors(texts, idf)[0]


@dataclass(frozen=True)
class Model:
    """labels, one unit row of ``centroids`` each, and the cosine below which a text of each size is rejected."""

    labels: tuple[str, ...]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def _document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(TOTAL, np.int64), 0
        for b in batches:
            for text in b["text"]:
                seen += profile(text) > 0
                n += 1
        yield pd.DataFrame({"dim": np.append(np.arange(TOTAL), -1), "n": np.append(seen, n)})

    counts = rows.select("text").mapInPandas(of, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TOTAL + 1, np.int64)
    out[counts["dim"]] = counts["n"]
    return out[:TOTAL], int(out[TOTAL])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Cluster number of each unit row; starts from rows far from each other, so reruns agree."""
    mean = x.mean(axis=0)
    first = [int(np.argmax(x @ mean))]
    near = x @ x[first[0]]
    for _ in range(1, min(k, len(x))):
        first.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[first[-1]])
    c = x[first]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return own


def bounds(texts: list[str], x: np.ndarray, own: np.ndarray, kept: list[int], idf: np.ndarray) -> np.ndarray:
    """(len(kept), SIZES) least cosines of one language from pieces of its sampled texts.

    Each text and, from its middle, its pieces of every size are measured against the clusters,
    their own without the text itself. A bound is the lower one of the size and the next smaller
    one, as a text at the lower end of a size lies farther than most of it. A size with few pieces in a cluster takes all of
    the language, or the next smaller size's bound, or, if none is smaller, the next larger one's;
    where there is no other text to tell, nothing is rejected.
    """
    sums = {j: x[own == j].sum(axis=0) for j in kept}
    fine = [i for i in range(len(texts)) if own[i] in sums and (own == own[i]).sum() > 1]
    rest = {i: sums[own[i]] - x[i] for i in fine}
    units = np.stack([sums[j] / np.linalg.norm(sums[j]) for j in kept]) if kept else np.zeros((0, TOTAL))
    far, size, of = [], [], []
    for p in range(1, SIZES + 2):
        long = {i: int(2 ** ((p + i * 0.618 % 1) / 2)) + 1 for i in fine}
        use = [i for i in fine if len(texts[i]) >= long[i]] if p <= SIZES else fine
        for at in range(0, len(use), 128):
            part = use[at : at + 128]
            cut = [texts[i] if p > SIZES else texts[i][(len(texts[i]) - long[i]) // 2 :][: long[i]] for i in part]
            v, c = sized_vectors(cut, idf)
            cos = v @ units.T
            for row, i in enumerate(part):
                if has_letter(cut[row]):
                    cos[row, kept.index(own[i])] = v[row] @ rest[i] / max(np.linalg.norm(rest[i]), 1e-12)
                    far.append(1 - cos[row].max())
                    size.append(c[row])
                    of.append(own[i])
    far, size, of = np.array(far), np.array(size, int), np.array(of, int)

    def least(d: np.ndarray) -> float:
        q = np.quantile(d, QUANTILE)
        return 1 - (q + SLACK * (q - np.median(d)))

    out = np.full((len(kept), SIZES), np.nan)
    for s in range(SIZES):
        every = size == s
        for row, j in enumerate(kept):
            mine = every & (of == j)
            use = mine if mine.sum() >= LEAST_PIECES else every
            if use.sum() >= LEAST_PIECES:
                out[row, s] = least(far[use])
    out = pd.DataFrame(out).ffill(axis=1).bfill(axis=1).fillna(-1.0).to_numpy()
    return np.minimum(out, np.concatenate([out[:, :1], out[:, :-1]], axis=1))


def fit(labelled: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE, text: str = "text", label: str = "lang") -> Model:
    """Learn from all rows of ``labelled`` with a label and a letter in the text.

    Document frequencies are counted over all of them. The centroids come from about ``sample``
    different texts of each label, or all if fewer, those that hash lowest, in one task per label; only the model, of
    ``clusters`` rows a label, comes to the driver. Clusters that look like mislabelled rows are
    dropped: the small ones, and those nearer to the mean of another language than to that of their
    own. No rows give a model that knows no language.
    """
    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    seen, n = _document_frequency(rows)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
    texts = rows.select("label", F.xxhash64("text").alias("h")).distinct().groupBy("label").count()
    sizes = written(texts.select("label", (F.lit(float(sample)) / F.col("count")).alias("share")), "labels")
    if sizes.count() <= MOST_LABELS:  # one row each; beyond that the join decides for itself
        sizes = F.broadcast(sizes)
    place = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    chosen = rows.join(sizes, "label").where(place < F.col("share")).select("label", "text").distinct()

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["text"])
        x = vectors(texts, idf)
        mean = x.mean(axis=0)
        own, out = spherical_kmeans(x, clusters), [(key[0], (mean / np.linalg.norm(mean)).tolist(), None)]
        kept = [int(j) for j in np.unique(own) if (own == j).sum() >= LEAST_SHARE * len(x)]
        for j, least in zip(kept, bounds(texts, x, own, kept, idf), strict=True):
            c = x[own == j].mean(axis=0)
            c /= np.linalg.norm(c)
            out.append((key[0], c.astype(np.float64).tolist(), least.tolist()))
        return pd.DataFrame(out, columns=["label", "centroid", "least"])

    found = chosen.select("label", "text").groupBy("label").applyInPandas(cluster, "label string, centroid array<double>, least array<double>").toPandas()
    found["order"] = [tuple(c) for c in found["centroid"]]
    found = found.sort_values(["label", "order"], kind="stable").drop(columns="order")
    means, found = found[found["least"].isna()], found[found["least"].notna()]
    if len(found):
        nearest = (np.stack(found["centroid"]) @ np.stack(means["centroid"]).T).argmax(axis=1)
        found = found[means["label"].to_numpy()[nearest] == found["label"].to_numpy()]
    centroids = np.stack(found["centroid"].map(np.asarray).tolist()) if len(found) else np.zeros((0, TOTAL))
    return Model(tuple(found["label"]), centroids.astype(np.float32), np.array(found["least"].tolist(), float).reshape(-1, SIZES), idf)


def predict(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the best cosine, 0 to 1) and ``rejected``, each name after ``prefix``.

    A text that is null or has no letter is ``und`` with score 0 and rejected, as is all if the
    model knows no language. Others get the language of the nearest centroid; rejected if even that
    is farther than nearly all pieces of the same size of texts it was learned from: a text of few
    n-grams lies far from any centroid, so each size has its own bound. Columns of ``docs`` of the
    same names give way.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "rejected": True})
            known = [i for i, t in enumerate(texts) if has_letter(t)] if m.labels else []
            for at in range(0, len(known), 32):
                part = known[at : at + 32]
                own = [texts.iloc[i] for i in part]
                x, size = sized_vectors(own, m.idf)
                cos = x @ m.centroids.T
                best = cos.argmax(axis=1)
                score = np.clip(cos[np.arange(len(part)), best].astype(float), 0, 1)
                out.loc[part, "lang_pred"] = [m.labels[j] for j in best]
                out.loc[part, "score"] = score
                out.loc[part, "rejected"] = score < m.least[best, size]
            yield out

    names = {c: prefix + c for c in ("lang_pred", "score", "rejected")}
    kept = [c for c in docs.columns if c not in names.values()]
    # Marked so, the function is not evaluated again for a filter on what it returns.
    judged = docs.select(*kept, of.asNondeterministic()(F.col(text)).alias("__judged"))
    return judged.select(*kept, *[F.col(f"__judged.{c}").alias(n) for c, n in names.items()])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) mod 4 is not 2 (a null id is not held out);
    label and id are no input of a prediction. Repeated rows are predicted alike; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("lang"), held_out(F.col(doc_id)).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), **options)
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
