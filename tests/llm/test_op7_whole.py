import random
import zlib

import numpy as np

from quillgraph.llm import boosted, toxicity_trees


def table(spark, seed=4, n=900):
    rnd = np.random.default_rng(seed)
    x = np.column_stack([rnd.integers(0, 9, n), rnd.random(n).round(2), np.where(rnd.random(n) < 0.03, rnd.random(n), 0)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0.7) ^ (rnd.random(n) < 0.1) | (x[:, 2] > 0)).astype(float)
    half = rnd.integers(0, 2, n)
    rows = spark.createDataFrame([(float(b), int(h), *map(float, a)) for a, b, h in zip(x, y, half, strict=True)], "y double, half int, a double, b double, c double")
    return x, y, half, rows.repartition(5)


def test_trees_by_passes_as_of_arrays(spark, monkeypatch):
    """Given the same edges, the same trees: of half 0, of half 1, and of all."""
    x, y, half, rows = table(spark)
    sets = [half == 0, half == 1, half >= 0]
    want = [boosted.Trees().fit(x[k], y[k]) for k in sets]
    monkeypatch.setattr(boosted, "_edges", lambda *_: [t.edges for t in want])
    got = boosted.fit_halves(rows, ["a", "b", "c"], [y[k].mean() for k in sets])
    for a, b in zip(got, want, strict=True):
        assert len(a.trees) == len(b.trees) and np.allclose(a.raw(x), b.raw(x), atol=1e-6)


def test_edges_of_a_table(spark):
    """Each edge has the rank asked for; rare values above the last have edges of their own."""
    x, _, half, rows = table(spark, n=3_000)
    for edges, mine in zip(boosted._edges(rows, ["a", "b", "c"], 32), (half == 0, half == 1, half >= 0), strict=True):
        for c, e in zip(x[mine].T, edges, strict=True):
            above = c[c > np.quantile(c, 31 / 32, method="inverted_cdf")]
            want = [np.quantile(c, k / 32, method="inverted_cdf") for k in range(1, 32)] + [np.quantile(above, q, method="inverted_cdf") for q in (0, 0.25, 0.5, 0.75) if len(above)]
            assert np.array_equal(e, np.unique(want))


def test_isotonic_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(boosted, "CHUNK", 7)
    rnd = random.Random(5)
    z = [rnd.choice([rnd.random(), round(rnd.random(), 1)]) for _ in range(700)]
    y = [float(rnd.random() < v**2) for v in z]
    got = boosted.isotonic_table(spark.createDataFrame(list(zip(z, y, strict=True)), "z double, y double").repartition(6))
    for a, b in zip(got, boosted.isotonic(np.array(z), np.array(y)), strict=True):
        assert np.allclose(a, b)


def test_isotonic_whatever_the_order():
    """Rows of one score are one point, in whatever order they come."""
    z, y = np.array([1, 2, 2, 2, 3.0]), np.array([1, 0, 1, 1, 1.0])
    a, b = boosted.isotonic(z, y), boosted.isotonic(z[::-1], y[::-1])
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def corpus(spark, n):
    rnd = random.Random(6)
    rows, labels = [], []
    for d in range(n):
        toxic = d % 5 == 0
        rows.append((d, " ".join(rnd.choice(["plain", "word", "you", "other", "thing"]) for _ in range(6)) + (f" zorg{'lum' if d % 2 else 'bax'}" if toxic else "")))
        labels.append((d, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_all_labelled_documents_count(spark):
    """More than the 12,000 that were learned from before, and each counts."""
    docs, labels = corpus(spark, 21_000)
    mine = [d for d in range(21_000) if zlib.crc32(str(d).encode()) % 3 != 1]
    sample = toxicity_trees._sample(docs, labels)
    assert len(mine) > 13_000 and sorted(r.doc_id for r in sample.select("doc_id").collect()) == mine
    assert toxicity_trees._counts(sample.where("y > 0.5"), 1)["=zorglum"] == tuple(sample.where(f"y > 0.5 and doc_id % 2 = 1 and half = {h}").count() for h in (0, 1))


def test_learned_by_passes(spark, monkeypatch):
    """Beyond what the driver holds: nearly the scores that it would learn; bits that tell terms hardly apart change nothing."""
    docs, labels = corpus(spark, 1_500)
    held = toxicity_trees.learn(docs, labels)
    monkeypatch.setattr(toxicity_trees, "MOST_HELD", 100)
    monkeypatch.setattr(toxicity_trees, "MOST_BITS", 8)
    passes = toxicity_trees.learn(docs, labels)
    assert passes["lexicon"] == held["lexicon"] and "=zorglum" in held["lexicon"]
    a, b = ({r.doc_id: r.s for r in toxicity_trees.score(docs, m, ["doc_id"], name="s").collect()} for m in (held, passes))
    assert max(abs(a[d] - b[d]) for d in a) < 0.02
    assert all((b[d] >= toxicity_trees.THRESHOLD) == (d % 5 == 0) for d in b)
