import random

import numpy as np
import xxhash

from quillgraph.llm.golay_simhash import Golay, fingerprint, fuzzy_keys, near_duplicates
from tests.llm.data import ODD, empty, odd


def slow_print(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow(rows):
    fp = [slow_print(t or "") for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [q[0] for q, g in zip(rows, group, strict=True) if g == group[i] and q[0] is not None]
        out.append((r[0], f"{fp[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_fingerprint():
    for text in ["A b C d E", "one", "", "É é\x85x\x1cy z w v", "word " * 5000, *[t or "" for _, t, *_ in ODD[:8]]]:
        assert fingerprint(text.encode()) == slow_print(text)


def test_no_link_is_lost():
    golay, rnd = Golay(), random.Random(7)
    words = np.arange(1 << 23, dtype=np.int32)
    assert len(np.unique(golay.decode(words))) == 4096
    for _ in range(3000):
        x = rnd.getrandbits(64)
        y = x
        for k in rnd.sample(range(64), rnd.randint(1, 4)):
            y ^= 1 << k
        a, b = (set(fuzzy_keys(golay, np.array([v], np.uint64))[0].tolist()) for v in (x, y))
        assert a & b


def test_query(spark):
    rnd = random.Random(9)
    rows = [(i, t) for i, t, *_ in ODD if not t or len(t) < 30_000]
    for g in range(12):
        base = [f"w{rnd.randint(0, 500)}" for _ in range(150)]
        for k in range(12):
            w = list(base)
            for _ in range(k % 4):
                w[rnd.randrange(150)] = "new"
            rows.append((100 * (g + 1) + rnd.randint(0, 10**6), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([tuple(r) for r in near_duplicates(docs).collect()], key=str)
    assert got == slow(rows)
    assert len(near_duplicates(odd(spark)).collect()) == len(ODD)
    assert near_duplicates(empty(spark)).count() == 0
