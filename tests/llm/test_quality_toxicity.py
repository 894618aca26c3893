import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import quality_rules, toxicity_trees, weak_labels
from quillgraph.llm.hashed_text import Rows, features, fit, platt
from tests.llm.data import ODD, empty, odd
from tests.llm.test_hashed_text import slow_features

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(4), spark.read.parquet(f"{SF}/labels.parquet")


def slow_rules(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for v in np.unique(score):
        at = np.flatnonzero(score[order] == v)
        rank[order[at]] = at.mean() + 1
    pos = y > 0.5
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_rules(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality_rules.quality(docs, labels).collect()}
    truth = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(truth)
    for i, text in truth.items():
        r, want = got[i], slow_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    y = {r.doc_id: r.quality for r in labels.collect()}
    right = [got[i].kept == bool(v) for i, v in y.items()]
    assert np.mean(right) > 0.93


def test_rules_odd(spark, tables):
    docs, labels = odd(spark), tables[1]
    for model in (None, quality_rules.learn(*tables)):
        rows = quality_rules.judge(docs, model).collect()
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(slow_rules(t) for _, t, *_ in ODD)
    assert quality_rules.quality(empty(spark), labels).count() == 0
    assert quality_rules.quality(docs, labels.limit(0)).count() == len(ODD)


def test_weak(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in weak_labels.weak_quality(docs).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([got[i].kept == bool(v) for i, v in y.items()]) > 0.9
    assert weak_labels.weak_quality(odd(spark)).count() == len(ODD)
    assert weak_labels.weak_quality(empty(spark)).count() == 0


def test_toxicity(spark, tables):
    docs, labels = tables
    rows = toxicity_trees.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    y = {r.doc_id: r.toxic for r in labels.collect()}
    test = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert auc(*map(np.array, zip(*test, strict=True))) > 0.8
    # the same text has the same score, whatever its id
    assert len({r.score for r in toxicity_trees.toxicity(spark.createDataFrame([(i, "you are a moron") for i in range(9)], "doc_id long, text string"), labels).collect()}) == 1


def test_toxicity_odd(spark, tables):
    docs, labels = odd(spark), tables[1]
    model = toxicity_trees.learn(*tables)
    assert toxicity_trees.score(docs, model, docs.columns, name="s").count() == len(ODD)
    assert toxicity_trees.toxicity(docs, labels.limit(0)).count() == len(ODD)
    assert toxicity_trees.toxicity(empty(spark), labels).count() == 0


def test_isotonic():
    rnd = random.Random(3)
    z = np.array([rnd.random() for _ in range(400)])
    y = np.array([float(rnd.random() < v**2) for v in z])
    at, p = toxicity_trees.isotonic(z, y)
    assert (np.diff(p) >= 0).all() and (np.diff(at) >= 0).all()
    assert np.abs(np.interp(z, at, p) - z**2).mean() < 0.12


def slow_estimate(counts, steps=60):
    """Expectation-maximisation by plain loops over vote patterns: prior and posteriors."""
    first = {0: (0.5, 0.3, 0.2), 1: (0.1, 0.3, 0.6)}
    m = len(next(iter(counts)))
    prior, table = 0.8, {(j, c, v): first[c][v] for j in range(m) for c in (0, 1) for v in range(3)}
    post = {}
    for _ in range(steps):
        for p in counts:
            a, b = prior, 1 - prior
            for j, v in enumerate(p):
                a, b = a * table[j, 1, int(v)], b * table[j, 0, int(v)]
            post[p] = a / (a + b)
        weight = {p: (n * (1 - post[p]), n * post[p]) for p, n in counts.items()}
        total = [sum(w[c] for w in weight.values()) for c in (0, 1)]
        table = {(j, c, v): (sum(w[c] for p, w in weight.items() if int(p[j]) == v) + 5 * first[c][v]) / (total[c] + 5) for j, c, v in table}
        prior = min(0.99, max(0.01, (total[1] + 4) / (sum(counts.values()) + 5)))
    return prior, post


def slow_votes(text):
    n, chars, symbols, dup, repeat = slow_rules(text)
    if not n:
        return "01111111"
    text = text or ""
    words = [w for w in text.encode().split()]
    step = lambda x, good, bad: (2 if x <= good else 0 if x >= bad else 1) if good < bad else (2 if x >= good else 0 if x <= bad else 1)
    mean = chars / n
    return "".join(map(str, (
        step(n, 30, 8), step(symbols / chars, 0.01, 0.08), step(sum("A" <= c <= "Z" for c in text) / max(1, chars - symbols), 0.12, 0.4), step(repeat / n, 0.05, 0.25),
        step(dup / (text.count("\n") + 1), 0.02, 0.3), step(sum(w.lower() in weak_labels.COMMON for w in words) / n, 0.12, 0.02),
        2 if 3 <= mean <= 8 else 0 if mean > 12 or mean < 2 else 1, step((text.count("!") + text.count("|")) / n, 0.02, 0.3),
    )))


def test_weak_against_slow_version(spark):
    """Votes, posteriors, training and scores of the query, worked out again without Spark."""
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in weak_labels.weak_quality(docs).collect()}
    counts = Counter(slow_votes(t) for t in texts.values())
    _, post = slow_estimate(counts)
    order = sorted(texts)
    dense = {d: slow_features(texts[d]) for d in order}
    y = np.array([post[slow_votes(texts[d])] for d in order])
    # all documents are in the sample
    sparse = []
    for d in order:
        at = np.flatnonzero(dense[d])
        sparse.append((at.astype(np.int32), dense[d][at].astype(np.float32)))
    rows = Rows(sparse)
    w, b = fit(rows, y, np.ones(rows.n))
    slope, offset = platt(rows.dot(w) + b, (y > 0.5).astype(float))
    for d in order:
        r = got[d]
        assert r.votes == slow_votes(texts[d]) and abs(r.posterior - post[r.votes]) < 1e-6
        want = 1 / (1 + np.exp(-np.clip(slope * (dense[d] @ w + b) + offset, -40, 40))) if (texts[d] or "").split() else r.posterior
        assert abs(r.score - want) < 1e-4 and r.kept == (r.score >= weak_labels.THRESHOLD)


def test_fit_against_slow_gradient():
    """One step of the regression by a dense matrix, and a falling loss."""
    rnd = np.random.default_rng(4)
    texts = [" ".join(rnd.choice(["good", "fine", "bad", "poor", "the", "a"], 12)) for _ in range(40)]
    rows = Rows(features(pa.array(texts)))
    x, y = np.stack([slow_features(t) for t in texts]), np.array([float(t.count("good") > t.count("bad")) for t in texts])
    z = rnd.standard_normal(x.shape[1])
    assert np.abs(rows.dot(z) - x @ z).max() < 1e-3
    r = rnd.standard_normal(len(y))
    assert np.abs(rows.back(r) - x.T @ r).max() < 1e-5
    w, b = fit(rows, y, np.ones(len(y)))
    loss = lambda w, b: -np.mean(np.log(np.where(y > 0.5, 1, -1) * ((1 / (1 + np.exp(-(x @ w + b)))) - 0.5) + 0.5))
    assert loss(w, b) < 0.5 * loss(0 * w, 0.0)


def slow_toxic_features(text, lexicon):
    """The sixteen features by loops over words."""
    raw = text.encode()
    words = [w.decode() for w in raw.split()]
    n = len(words)
    if not n:
        return [0.0] * 16
    undo = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""}
    bare = [toxicity_trees._EDGE.sub("", w) for w in words]
    fixed, learned, starts, hidden, inside, second, capitals, capital = ([False] * n for _ in range(8))
    for k, b in enumerate(bare):
        w = b.lower()
        fixed[k], learned[k], second[k] = w in toxicity_trees.INSULTS, "=" + w in lexicon, w in toxicity_trees.SECOND
        starts[k] = any(len(w) >= m and w[:m] in lexicon for m in (4, 5, 6))
        capitals[k] = len(b) > 1 and b.isupper()
        capital[k] = not capitals[k] and b[:1].isupper()
        inside[k] = bool(w) and not w.isalpha() and any(c.isalpha() for c in w)
        plain = "".join(undo.get(c, c) for c in w)
        hidden[k] = inside[k] and plain != w and (plain in toxicity_trees.INSULTS or "=" + plain in lexicon)
    hits = [k for k in range(n) if fixed[k] or learned[k] or starts[k] or hidden[k]]
    you = [k for k in range(n) if second[k]]
    gaps = [min(abs(h - s) for s in you) for h in hits] if you else []
    runs = [b - a for a, b in zip(hits, hits[1:], strict=False)]
    # the first hit counts as if one stood nine words before the text
    run = min([hits[0] + 9, *runs]) if len(hits) > 1 else 50
    rate = lambda x: sum(x) / n
    return [rate(fixed), rate(learned), rate(starts), len(hits) / n, min(20, len(hits)), rate(hidden), rate(inside), rate(second), sum(g <= 5 for g in gaps) / n, min([50, *gaps]), rate(capitals), rate(capital), sum(c in b"!?.,;:*#$%&|<>\"'()-" for c in raw) / len(raw), text.count("!") / n, min(50, run), np.log1p(n)]


def test_toxic_features_against_slow_version(tables):
    docs, labels = tables
    rnd = random.Random(8)
    lexicon = frozenset(["=grom", "snar", "flibb", "=zed"])
    parts = ["you", "YOU", "idiot", "1d10t", "Grom!", "gr0m", "snarl", "snark-y", "flibbert", "zed", "(zed)", "the", "Word", "...", "a.b", "é", "漢字", "tú", "!!"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [r.text or "" for r in docs.limit(100).collect()]
    codes = toxicity_trees.Memo(lambda w: toxicity_trees.word_code(w, lexicon))
    for t in texts:
        assert np.allclose(toxicity_trees.features(t.encode(), codes), slow_toxic_features(t, lexicon)), t


def test_tree_against_all_splits():
    """One round of depth two: each split is the best of all, each leaf its Newton step."""
    rnd = np.random.default_rng(6)
    x = rnd.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3) ^ (rnd.random(120) < 0.1)).astype(float)
    t = toxicity_trees.Trees(rounds=1, depth=2).fit(x, y)
    base = np.log(y.mean() / (1 - y.mean()))
    g, h = y - y.mean(), np.full(120, y.mean() * (1 - y.mean()))
    value = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)

    def best(rows):
        found = (1e-6, None)
        for f in range(3):
            for edge in np.unique(x[:, f])[1:]:
                right = rows & (x[:, f] >= edge)
                left = rows & ~right
                if h[left].sum() >= t.least and h[right].sum() >= t.least and value(left) + value(right) - value(rows) > found[0] + 1e-12:
                    found = (value(left) + value(right) - value(rows), (left, right))
        return found[1] or (rows, rows & False)

    want = np.zeros(120)
    for part in best(np.ones(120, bool)):
        for leaf in best(part):
            want[leaf] = base + t.rate * g[leaf].sum() / (h[leaf].sum() + 1)
    assert np.allclose(t.raw(x), want)


def test_lexicon_counts(spark):
    """Counts of terms by half and label, against sets of words."""
    rnd = random.Random(9)
    rows = [(k, " ".join(rnd.choice(["Alpha", "beta,", "gamma!", "x" * 70, "délta", "epsilon"]) for _ in range(8)), float(k % 3 == 0), k % 2) for k in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y double, half int").repartition(3)
    want = {}
    for _, text, y, half in rows:
        for t in {t for w in text.split() for t in toxicity_trees.terms(w)}:
            want.setdefault(t, [0, 0])[half] += 1
    want = {t: tuple(n) for t, n in want.items()}
    assert toxicity_trees._counts(sample, 1) == want and len(want) > 15
    assert toxicity_trees._counts(sample, 50) == {t: n for t, n in want.items() if sum(n) >= 50}
    some = frozenset(sorted(want)[::3])
    assert toxicity_trees._counts(sample, 1, some) == {t: n for t, n in want.items() if t in some}
    # words of more than 60 characters count, too
    assert any(t.startswith("#") for t in want)


def test_lexicons(spark):
    """Terms by their counts in both halves, chosen by loops."""
    rnd = random.Random(12)
    rows = [(k, " ".join(rnd.choice(["grom", "flib", "snark"] if k % 4 == 0 and rnd.random() < 0.4 else ["alpha", "beta", "gamma"]) for _ in range(6)), float(k % 4 == 0), k % 3 % 2) for k in range(200)]
    for use, got in zip(((0,), (1,), (0, 1)), toxicity_trees._lexicons(spark.createDataFrame(rows, "doc_id long, text string, y double, half int").repartition(3)), strict=True):
        mine = [(set(toxicity_trees.Memo(lambda t: [x for w in t.split() for x in toxicity_trees.terms(w)])[text]), y) for _, text, y, half in rows if half in use]
        toxic, clean = sum(y for _, y in mine), sum(1 - y for _, y in mine)
        want = set()
        for t in set().union(*(s for s, _ in mine)):
            a, b = sum(t in s and y == 1 for s, y in mine), sum(t in s and y == 0 for s, y in mine)
            if a >= 3 and a / toxic / ((b + 0.5) / (clean + 1)) >= 8:
                want.add(t)
        assert got == want and "=grom" in got and "=alpha" not in got


def test_bound_on_rows(spark):
    """Many rows of few ids: the sample has one row an id."""
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(3000)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1, 1) for k in range(3)], "doc_id long, quality int, toxic int")
    assert quality_rules.labelled(docs, labels, "quality", 2).count() == 2
    assert toxicity_trees._sample(docs, labels, 2).count() <= 2
    assert weak_labels.weak_quality(docs, max_sample=2).count() == 3000


def test_names_with_backticks(spark, tables):
    docs = odd(spark).withColumnRenamed("n_words", "a`b")
    assert toxicity_trees.score(docs, toxicity_trees.learn(*tables), docs.columns, name="s").columns == [*docs.columns, "s"]
