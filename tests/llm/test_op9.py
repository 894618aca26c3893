import hashlib
import random
import re

from quillgraph.llm.window_doubling import longest_repeats, remove_repeats
from tests.llm.data import ODD, empty, odd


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow(rows, length=13):
    first = {}
    for doc, text, *_ in rows:
        w = words_of(text)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if doc is not None:
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - length + 1):
            if doc is not None and first[tuple(w[i : i + length])] < doc:
                gone |= set(range(i, i + length))
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def planted(seed=4, docs=60):
    rnd = random.Random(seed)
    shared = [[f"p{k}x{i}" for i in range(rnd.randint(10, 60))] for k in range(6)]
    rows = []
    for d in range(docs):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += [f"v{rnd.randint(0, 40)}" for _ in range(rnd.randint(0, 30))]
            p = rnd.choice(shared)
            a = rnd.randint(0, 5)
            w += p[a : rnd.randint(a, len(p))]
        rows.append((d * 3, rnd.choice([" ", "\n", "  "]).join(w)))
    return rows + rows[5:9] + [(1000 + i, t) for i, t in rows[:10]] + [(None, rows[3][1])]


def test_against_brute_force(spark):
    rows = planted() + [(i, t) for i, t, *_ in ODD if not t or len(t) < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted([tuple(r) for r in remove_repeats(docs).collect()], key=str)
    assert got == slow(rows)


def test_longest(spark):
    base = [f"a{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, "x " + " ".join(base[:55])), (3, " ".join(base[10:30])), (4, "y " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in longest_repeats(docs).collect()} == {(1, 52), (2, 52), (3, 13)}


def test_odd(spark):
    assert remove_repeats(odd(spark)).count() == len(ODD)
    assert remove_repeats(empty(spark)).count() == 0
    assert longest_repeats(empty(spark)).count() == 0
