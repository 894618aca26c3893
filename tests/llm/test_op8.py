import random

import numpy as np

from quillgraph.llm.latent_decontamination import COMMON, COSINE, WINDOW, Block, Finder, clean, common_length, leaks
from tests.llm.data import ODD, empty, odd


def slow_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_length():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        assert common_length(a, b) == slow_common(a, b)


def test_norms():
    block = Block([(1, "a b c a d"), (2, "b b b")])
    block.weigh({0: 1, 1: 3}, 9)
    rows = np.array([[0, 1, 2, 0], [1, 1, 1, -1], [-1, -1, 3, 0]])
    for row, scale in zip(rows, block.scale(rows), strict=True):
        x = {}
        for k, w in enumerate(row):
            key = w if w >= 0 else ("out", k)
            x[key] = x.get(key, 0) + block.idf[w]
        assert abs(scale - 1 / np.sqrt(sum(v * v for v in x.values()))) < 1e-12


def planted(seed=5, docs=300):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.4 else "".join(rnd.choice(["ba", "ke", "lo", "mi", "tu", "ra"]) for _ in range(rnd.randint(1, 4)))
    bench = [(k, " ".join(word() for _ in range(rnd.randint(15, 50)))) for k in range(30)] + [(90, None), (91, ""), (92, "one two three")]
    rows, truth = [], set()
    for d in range(docs):
        w = [word() for _ in range(rnd.randint(0, 300))]
        if d % 5 == 0:
            k, text = bench[rnd.randrange(30)]
            t = text.split()
            if d % 2:
                for _ in range(max(1, len(t) // 10)):
                    t[rnd.randrange(len(t))] = "changed"
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() + "," if rnd.random() < 0.1 else x for x in t]
            truth.add((d, k))
        rows.append((d, rnd.choice([" ", "\n"]).join(w)))
    return rows, bench, truth


def test_planted(spark):
    rows, bench, truth = planted()
    docs = spark.createDataFrame(rows + [(i and i + 10_000, t) for i, t, *_ in ODD], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    assert truth <= got and len(got - truth) <= 3
    kept = {r.doc_id for r in clean(docs, items).collect()}
    assert kept.isdisjoint({d for d, _ in truth})
    assert len(kept) >= docs.select("doc_id").distinct().count() - len(truth) - 3


def test_odd(spark):
    items = spark.createDataFrame([(1, "one two three"), (None, "x y z w")], "item_id long, text string")
    assert leaks(odd(spark), items).count() >= 3
    assert leaks(empty(spark), items).count() == 0
    assert leaks(odd(spark), items.limit(0)).count() == 0
    assert clean(odd(spark), items.limit(0)).count() == len(ODD)
    assert clean(odd(spark), items).columns == odd(spark).columns


def fitted(seed, n):
    """A block of items, fitted on its own passages as in a corpus of ``n`` documents."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(900)]
    word = lambda: vocabulary[min(int(rnd.paretovariate(0.5)), 900) - 1]
    block = Block([(k, " ".join(word() for _ in range(rnd.randint(15, 60)))) for k in range(60)])
    block.weigh({k: int(n * min(0.5, 2 / (1 + vocabulary.index(w.decode())))) for w, k in block.vocabulary.items()}, n)
    x = []
    for _, w in block.items:
        rows, scale = block.passages(np.array(w), min(WINDOW, len(w)))
        for row, by in zip(rows, scale, strict=True):
            x.append(np.bincount(row, block.idf[row] * by, len(block.vocabulary)))
    v = np.linalg.svd(np.array(x), full_matrices=False)[2][:64].T
    block.finish(np.vstack([v, np.zeros((1, v.shape[1]))]))
    return rnd, vocabulary, block


def replaced(rnd, block, share):
    """A text of outside words that holds one item, ``share`` of its words replaced by outside ones."""
    k = rnd.randrange(len(block.items))
    words = list(block.items[k][1])
    for i in rnd.sample(range(len(words)), round(share * len(words))):
        words[i] = -1
    around = lambda: [-1 if rnd.random() < 0.7 else rnd.randrange(len(block.vocabulary)) for _ in range(rnd.randint(0, 80))]
    return k, np.array(around() + words + around())


def by_words_alone(block, ids, k):
    """The final test at every place of the text."""
    words = block.items[k][1]
    slack, n = max(4, len(words) // 3), len(ids)
    for cell in range(-(len(words) // slack) - 1, n // slack + 1):
        around = ids[max(0, cell * slack - slack) : max(0, (cell + 2) * slack + len(words))].tolist()
        if 2 * len(block.answers[k] & set(around)) >= len(block.answers[k]) and common_length(words, around) >= COMMON * len(words):
            return True
    return False


def test_recall_of_replaced_words():
    for n in (1_000, 100_000, 10_000_000):
        rnd, _, block = fitted(3, n)
        finder = Finder(block)
        for share in (0.2, 0.3, 0.4):
            held = lost = 0
            for _ in range(100):
                k, ids = replaced(rnd, block, share)
                found = {r[0] for r in finder.search(ids)}
                held += by_words_alone(block, ids, k)
                lost += by_words_alone(block, ids, k) and k not in found
                assert all(by_words_alone(block, ids, j) for j in found)
            assert held >= 20 and lost <= held // 25


def all_windows(block, ids):
    """Every window against every item, nothing left out."""
    out = {}
    for k, (_, words) in enumerate(block.items):
        length, targets, offset = block.targets[k]
        length, slack = min(length, len(ids)), max(4, len(words) // 3)
        for p in range(len(ids) - length + 1):
            row = ids[p : p + length]
            z = (block.v[row] * block.idf[row][:, None].astype(np.float32)).sum(axis=0)
            cosine = z @ targets / max(np.linalg.norm(z), 1e-12)
            for j in np.flatnonzero(cosine >= COSINE).tolist():
                cell = int(p - offset[j]) // slack
                around = ids[max(0, cell * slack - slack) : (cell + 2) * slack + len(words)].tolist()
                if 2 * len(block.answers[k] & set(around)) >= len(block.answers[k]):
                    share = common_length(words, around) / len(words)
                    if share >= COMMON:
                        out[k] = max(share, out.get(k, 0))
    return out


def test_same_as_all_windows():
    rnd, _, block = fitted(4, 5_000)
    finder = Finder(block)
    for share in (0, 0.2, 0.35, 0.4) * 3:
        _, ids = replaced(rnd, block, share)
        assert {r[0]: r[2] for r in finder.search(ids)} == all_windows(block, ids)


def test_recall_of_words_replaced_by_benchmark_words():
    rnd, _, block = fitted(3, 10_000)
    finder, held, lost = Finder(block), 0, 0
    for share in (0.25, 0.3, 0.35) * 100:
        k, ids = replaced(rnd, block, share)
        at = ids == -1
        ids[at] = [rnd.randrange(len(block.vocabulary)) for _ in range(at.sum())]
        if by_words_alone(block, ids, k):
            held += 1
            lost += k not in {r[0] for r in finder.search(ids)}
    assert held >= 200 and lost <= held // 100


def test_texts_shorter_than_a_window():
    """Eleven words of a twelve-word item are a text of less than a window."""
    rnd, _, block = fitted(6, 5_000)
    finder, tried, found = Finder(block), 0, 0
    short = [k for k, (_, w) in enumerate(block.items) if len(w) <= 18]
    for k in short * 5:
        words = block.items[k][1]
        ids = np.array([w for i, w in enumerate(words) if i not in rnd.sample(range(len(words)), max(1, len(words) - 11))][:11])
        assert {r[0]: r[2] for r in finder.search(ids)} == all_windows(block, ids)
        if by_words_alone(block, ids, k):
            tried += 1
            found += k in {r[0] for r in finder.search(ids)}
    assert tried >= 5 and found >= 0.9 * tried
    assert finder.search(np.zeros(0, np.int64)) == []
