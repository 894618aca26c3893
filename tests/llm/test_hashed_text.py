import numpy as np
import pyarrow as pa
import xxhash

from quillgraph.llm.hashed_text import GRAMS, SIZE, SLOTS, Scorer, Words, features, gram_slots
from tests.llm.data import ODD

MANY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def gram_slot(gram):
    h = (len(gram) + sum(ord(c) * m for c, m in zip(gram, MANY, strict=False))) % 2**64
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 40) % SLOTS


def test_grams_of_whole_words():
    words = ["a", "short", "é漢字😀", "a" * 20 + "".join(chr(97 + i * i % 26) for i in range(500)) + "b" * 20, "https://example.org/" + "x1y2" * 5_000, "\x02\x03"]
    slots, first, total = gram_slots([w.encode() for w in words])
    for word, a, n in zip(words, first.tolist(), total.tolist(), strict=True):
        w = f"\x02{word}\x03"
        assert slots[a : a + n].tolist() == [gram_slot(w[i : i + n]) for n in GRAMS for i in range(len(w) - n + 1)]


def test_words():
    texts = [t for _, t, *_ in ODD] + ["", " a  b\n", "\x1c\x85x y", None]
    w = Words(pa.array(texts, pa.string()).slice(2))
    for text, found in zip(texts[2:], w.texts(np.arange(len(w.words))), strict=True):
        assert [w.words[k] for k in found] == (text or "").encode().split()
    assert w.sums(np.ones(len(w.which))).tolist() == [len((t or "").encode().split()) for t in texts[2:]]
    assert Words(pa.array([None, ""], pa.string())).sizes.tolist() == [0, 0]


def slow_features(text):
    """Dense means over the words of a text: words, pairs of neighbours, n-grams of each word."""
    words = (text or "").encode().split()
    x = np.zeros(SIZE)
    h = [xxhash.xxh64_intdigest(w) for w in words]
    for k in h:
        x[(k >> 20) % SLOTS] += 1 / len(words)
    for a, b in zip(h, h[1:], strict=False):
        x[SLOTS + ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 40) % SLOTS] += 1 / len(words)
    for w in words:
        t = f"\x02{w.decode()}\x03"
        slots = [gram_slot(t[i : i + n]) for n in GRAMS for i in range(len(t) - n + 1)]
        for k in slots:
            x[2 * SLOTS + k] += 1 / len(slots) / len(words)
    return x


def test_features_and_scores_of_texts():
    weights = np.random.default_rng(2).standard_normal(SIZE)
    texts = pa.array(["", "a", "two words", "the cat and the cat and the dog " * 30, None, "é漢字😀 naïve " * 5, " "], pa.string())
    score = Scorer(weights, 0.25)(Words(texts))
    for text, (at, x), s in zip(texts.to_pylist(), features(texts), score, strict=True):
        want, got = slow_features(text), np.zeros(SIZE)
        got[at] = x
        assert np.abs(got - want).max() < 1e-6
        assert abs(s - (0.25 + want @ weights)) < 1e-9
    # alone or among others, the score is the same to the last bit
    assert score.tolist() == [Scorer(weights, 0.25)(Words(texts.slice(k, 1)))[0] for k in range(len(texts))]
