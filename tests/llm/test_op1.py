import hashlib
import math
import random
import re
from collections import Counter

from quillgraph.llm.pii_labellers import BASE, EXTRA, LABELLERS, PATTERNS, STEPS, THRESHOLD, candidates, personal_data, reliabilities
from tests.llm.data import ODD, empty, odd

KINDS = ["email", "ip", "card", "phone"]


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def slow(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def want(text):
    s = slow(text)
    j = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s)
    return tuple(sum(k == i for _, k, _ in s) for i in range(4)) + (hashlib.sha256(j.encode()).hexdigest(),)


def some_texts(n=400):
    rnd = random.Random(1)
    parts = ["a@b.c", "x.y%z@d-e.f.g", "@", "a@b@c.d.e%f@g.h", "1.2.3.4", "256.1.1.1", "001.2.3.255", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 123-4567", "+49", "++33 1.2.3.4.5.6.7.8)))", "é😀", " ", "-", ".", "\n", "12", "mail", "Mr. Peter Schmidt", "call 212-555-1234", "ssn 123-45-6789", "x (at) y (dot) com", "DE44 5001 0517 5407 3249 31", "0"]
    return ["".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_base(spark):
    rows = [(i, t) for i, t in enumerate(some_texts())] + [(10_000 + k, t) for k, (_, t, *_) in enumerate(ODD)] + [(20_000, "a@" * 50_000), (20_001, "+1 " + "(" * 50_000), (20_002, "1." * 50_000), (20_003, "x" * 200_000 + "@y.z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:6] for r in personal_data(docs).collect()}
    for i, t in rows:
        assert got[i] == want(t), (i, t[:200] if t else t)


def test_added(spark):
    docs = spark.createDataFrame([(i, f"please call phone {200 + i}-555-{1000 + i}, ssn 123-45-{6789 - i} or write mail to joe (at) site (dot) com") for i in range(30)], "doc_id long, text string")
    rows = personal_data(docs).collect()
    assert all("national_phone" in r.spans and "ssn" in r.spans for r in rows)
    found = candidates(docs).selectExpr("explode(concat(base, extra)) as x").select("x.k", "x.v")
    for r in reliabilities(found).collect():
        assert 0 < r.prior < 1 and all(abs(sum(p) - 1) < 1e-6 for p in r.yes + r.no)


def test_odd(spark):
    assert personal_data(odd(spark)).count() == len(ODD)
    assert personal_data(empty(spark)).count() == 0


def slow_reliabilities(counts):
    """Expectation-maximisation and the span classifier for one kind, by plain loops."""
    first = {"yes": [0.15, 0.3, 0.55], "no": [0.5, 0.35, 0.15]}
    prior, yes, no = 0.5, [list(first["yes"]) for _ in range(LABELLERS)], [list(first["no"]) for _ in range(LABELLERS)]

    def posterior(v):
        a, b = prior, 1 - prior
        for j, x in enumerate(v):
            a, b = a * yes[j][x], b * no[j][x]
        return a / (a + b)

    for _ in range(STEPS):
        q = {v: posterior(v) for v in counts}
        all_n, all_yes = sum(counts.values()), sum(n * q[v] for v, n in counts.items())
        yes, no = ([[(4 * first[side][u] + sum(n * (q[v] if side == "yes" else 1 - q[v]) for v, n in counts.items() if v[j] == u)) / (4 + (all_yes if side == "yes" else all_n - all_yes)) for u in range(3)] for j in range(LABELLERS)] for side in ("yes", "no"))
        prior = (2 + all_yes) / (4 + all_n)
    q = {v: posterior(v) for v in counts}
    w = [0.0] * (LABELLERS + 1)
    score = lambda v: 1 / (1 + math.exp(-(w[0] + sum(a * (x - 1) for a, x in zip(w[1:], v, strict=True)))))
    for _ in range(60):
        p = {v: score(v) for v in counts}
        grad = [sum(n * (q[v] - p[v]) * (1 if j == 0 else v[j - 1] - 1) for v, n in counts.items()) / (1 + sum(counts.values())) for j in range(LABELLERS + 1)]
        w = [a + 2 * g - 0.002 * a for a, g in zip(w, grad, strict=True)]
    return prior, yes, no, w, score


def test_added_against_slow_version(spark):
    """Candidates by Python's engine; votes counted, reliabilities and classifier by loops."""
    texts = some_texts(300) + [f"please call phone {200 + i}-555-{1000 + i}, ssn 123-45-{6789 - i} or write mail to joe (at) site (dot) com, DE44 5001 0517 5407 32{i:02d} 31, Dear Mr. Peter Schmidt{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen = {r.doc_id: r for r in candidates(docs).collect()}
    for i, t in enumerate(texts):
        base = [(x.s, x.e) for x in seen[i].base]
        loose = sorted((m.start(), m.end(), k) for k in EXTRA for m in re.finditer(PATTERNS[k][0].replace(r"\p{Lu}", "[A-Z]").replace(r"\p{Ll}", "[a-z]"), t) if not any(a < m.end() and m.start() < b for a, b in base))
        assert sorted((x.s, x.e, x.k) for x in seen[i].extra) == loose, t
    counts = {}
    for r in seen.values():
        for x in [*r.base, *r.extra]:
            counts.setdefault(x.k, Counter())[tuple(x.v)] += 1
    fast = {r.k: r for r in reliabilities(candidates(docs).selectExpr("explode(concat(base, extra)) as x").select("x.k", "x.v")).collect()}
    assert fast.keys() == counts.keys()
    score = {}
    for k, c in counts.items():
        prior, yes, no, w, score[k] = slow_reliabilities(c)
        assert abs(fast[k].prior - prior) < 1e-9
        assert all(abs(a - b) < 1e-9 for x, y in ((fast[k].yes, yes), (fast[k].no, no)) for r, s in zip(x, y, strict=True) for a, b in zip(r, s, strict=True))
        assert all(abs(a - b) < 1e-9 for a, b in zip(fast[k].weights, w, strict=True))
    order = [*BASE, *EXTRA]
    for r in personal_data(docs).collect():
        spans = [(x.s, order.index(x.k), x.e) for x in seen[r.doc_id].base] + [(x.s, order.index(x.k), x.e) for x in seen[r.doc_id].extra if score[x.k](tuple(x.v)) >= THRESHOLD]
        assert r.spans == ",".join(f"{order[k]}:{a}:{b}" for a, k, b in sorted(spans))
