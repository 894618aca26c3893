import random

import numpy as np

from quillgraph.llm import latent_decontamination as op8
from tests.llm.test_op8 import by_words_alone, planted


def slow_passages(block, texts):
    """Weighted passages: half a window after the other, the last of the words that are left."""
    out = []
    for t in texts:
        ids = op8.Finder(block).ids((t or "").encode())
        for s in range(0, max(1, len(ids) - op8.HALF), op8.HALF):
            row = ids[s : s + op8.WINDOW]
            if len(row):
                scale = block.scale(row[None])[0]
                out.append(np.bincount(row[row >= 0], block.idf[row[row >= 0]] * scale, len(block.vocabulary)))
    return np.array(out)


def some_texts(n):
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefghijklmnopqrst")
    texts = [None, "", "a", " ".join("abc" * 4), " ".join(word() for _ in range(70_000))]
    while len(texts) < n:
        texts.append(" ".join(word() + (rnd.choice("xyz") if k % 3 else "") for k in range(rnd.randint(0, 40))))
    return texts


def test_product_against_slow_version():
    block = op8.Block([(1, "a b c d e f g ax by cz dx ey fz gx"), (2, "a a b")])
    block.weigh({k: k for k in range(len(block.vocabulary))}, 50)
    texts = some_texts(300)
    x = slow_passages(block, texts)
    q = np.random.default_rng(0).standard_normal((len(block.vocabulary), 5))
    total = np.zeros(q.shape)
    weighted = np.vstack([q * block.idf[:-1, None], np.zeros((1, 5))])
    op8.add_product(block, *op8.halves([op8.Finder(block).ids((t or "").encode()) for t in texts]), weighted, total)
    op8.add_product(block, *op8.halves([np.zeros(0, np.int64)]), weighted, total)
    assert np.allclose(total * block.idf[:-1, None], x.T @ (x @ q))


def test_fit_takes_all_documents(spark):
    """More documents than the sample had (1,500): of one doc_id, of none, and short ones too."""
    texts = some_texts(2_500)
    rows = [(None if k % 7 == 0 else k // 2, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = [(1, "a b c d e f g ax by cz dx ey fz gx"), (2, "h i j")]
    (block,) = op8.fitted_blocks(docs, spark.createDataFrame(items, "item_id long, text string"))
    x = [slow_passages(block, texts)]
    for _, w in block.items:
        own, scale = block.passages(np.array(w), min(op8.WINDOW, len(w)))
        x += [np.bincount(r, block.idf[r] * by, len(block.vocabulary))[None] for r, by in zip(own, scale, strict=True)]
    assert len(block.vocabulary) < op8.RANK  # so the values are those of the whole matrix
    assert np.allclose(block.singular, np.linalg.svd(np.vstack(x), compute_uv=False))


def test_parts_of_the_sums(spark):
    """A vocabulary of several parts, some tasks without rows."""
    block = op8.Block([(1, " ".join(f"w{k}" for k in range(op8.PART + 700)))])
    block.weigh({}, 9)
    texts = [" ".join(f"w{k % (op8.PART + 900)}" for k in range(s, s + 30)) for s in range(0, 6_000, 17)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).where("doc_id >= 0")
    x = slow_passages(block, texts)
    q = np.random.default_rng(0).standard_normal((len(block.vocabulary), 3))
    assert np.allclose(op8._product(op8._numbered(docs, block), block, q), x.T @ (x @ q))
    assert op8._product(op8._numbered(docs.limit(0), block), block, q).any().item() is False


def test_recall_of_the_fitted_search(spark):
    """Against the final test at every place, a third of the words replaced."""
    rows, bench, _ = planted(seed=8, docs=0)
    rnd = random.Random(9)
    around = lambda: [f"{rnd.choice('bklmt')}{rnd.choice('aeiou')}{rnd.randrange(60)}" for _ in range(rnd.randint(0, 80))]
    for d in range(300):
        t = rnd.choice(bench[:30])[1].split()
        for i in rnd.sample(range(len(t)), len(t) * rnd.randint(20, 38) // 100):
            t[i] = rnd.choice(around() or ["other"])
        rows.append((d, " ".join(around() + t + around())))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    (block,) = op8.fitted_blocks(docs, items)
    found = {(r.doc_id, r.item_id) for r in op8.leaks(docs, items).collect()}
    finder = op8.Finder(block)
    held = {(d, block.items[k][0]) for d, t in rows for k in range(len(block.items)) if by_words_alone(block, finder.ids(t.encode()), k)}
    assert len(held) > 200 and found <= held and len(found) >= 0.95 * len(held)
