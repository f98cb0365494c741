"""Lexical search against brute force; bounds never below exact scores; odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from strider.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = {}
    for item, wanted in queries.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in counted) + 1))) for t in wanted}
        scores = []
        for i, c in counted:
            if c:
                m = 50 + (50 * c.total() * n_docs) // n_terms
                s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
                scores += [(s, i)] if s > 0 else []
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for rank, (s, i) in enumerate(scores[:50], 1):
            out[item, rank] = (i, s)
    return out


def got(df):
    rows = df.collect()
    out = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(3000)])
    shares = 1 / np.arange(1, 3001)
    shares /= shares.sum()
    docs = [(k, " ".join(rng.choice(words, int(rng.integers(1, 300)), p=shares))) for k in range(n)]
    items = [(k, " ".join(rng.choice(words, 25, p=shares)) + (" " + docs[k][1][:200] if k % 3 == 0 else "")) for k in range(12)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    odd = [(1000, None), (1001, ""), (1002, "?! ..."), (1003, docs[0][1]), (1003, docs[0][1]), (None, docs[0][1]), (None, docs[6][1] + " more"), (5, docs[3][1]), (1004, "w9 " * 5000), (1005, "É W5_w6-W7 İ ß\U0001f600 w8")]
    items += [(50, None), (51, "nowhere"), (52, "w5 É İ"), (None, "w9 w8"), (53, "w1 w2"), (53, "w3"), (54, "??")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 as item", "2 as items", "'a' as of", "3 as size").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as item", "8 as doc_id")
    assert got(lexical.search(d, q)) == brute(docs + odd, items)


@pytest.mark.parametrize("most", [1, 40])
def test_batches_of_items_find_the_same(spark, monkeypatch, most):
    docs, items = corpus(150, 5)
    items = items[:4]
    monkeypatch.setattr(lexical, "batches_of", lambda rows, f=lexical.batches_of: f(rows, most))
    assert got(lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_bounds_hold_and_exclude():
    docs, items = corpus(300, 8)
    batch = next(lexical.batches_of(items))
    counted = [Counter(lexical.terms(t)) for _, t in docs]
    n_terms = sum(c.total() for c in counted)
    batch.weigh(Counter(t for c in counted for t in c), len(docs))
    import pyarrow as pa

    given = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    loose = 0
    for b in lexical._signer(batch.vocabulary, pa.int64(), True)(iter([given])):
        for ids, lengths, slices in zip(b.column("doc_ids").to_pylist(), b.column("lengths").to_pylist(), b.column("slices").to_pylist(), strict=True):
            if ids is None:
                continue
            grid = np.frombuffer(slices, np.uint8).reshape(-1, -(-len(ids) // 8))
            caps = lexical.impact_bounds(np.array(lengths), len(docs), n_terms)
            bound = lexical.bounds(grid, caps, batch, slice(0, len(items)))
            for column, i in enumerate(ids):
                c, m = counted[i], 50 + (50 * counted[i].total() * len(docs)) // n_terms
                for k, row in enumerate(batch.rows):
                    tf = {t: c[batch.vocabulary[t]] for t in row}
                    exact = sum(int(batch.weights[t]) * ((10**9 * x) // (1000 * x + 20 * m)) for t, x in tf.items())
                    assert bound[k, column] >= exact
                    loose += bound[k, column] > 1.5 * exact + 10**8
    assert loose < 0.2 * len(docs) * len(items)


def test_few_documents_and_empty_tables(spark):
    doc = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    item = lambda rows: spark.createDataFrame(rows, "item_id string, text string")
    assert got(lexical.search(doc([(1, "a b"), (2, "b")]), item([("x", "a b c")]))) == brute([(1, "a b"), (2, "b")], [("x", "a b c")])
    assert lexical.search(doc([]), item([("x", "a")])).count() == 0
    assert lexical.search(doc([(1, None), (2, "..")]), item([("x", "a")])).count() == 0
    assert lexical.search(doc([(1, "a")]), item([])).count() == 0
