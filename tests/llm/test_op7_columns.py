import random
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import toxicity_trees
from quillgraph.llm.hashed_text import Words
from tests.llm.test_quality_toxicity import slow_toxic_features

PARTS = ["you", "YOU", "idiot", "1d10t", "Grom!", "gr0m", "snarl", "_snark-y_", "flibbert", "zed", "(zed)", "the", "Word", "...", "a.b", "é", "漢字", "tú", "!!", "ÉTÉ", "ǅ", "Aª", "İstanbul", "ẞa", "¿tú?", "«Été»", "ʰa", "ΣΑΣ", "x" * 61, "É" * 40, "don't", "’tis", "12", "²"]
LEXICON = frozenset(["=grom", "snar", "flibb", "=zed", "=été", toxicity_trees.whole("x" * 61), "i̇sta"])
#: The slow version knows long words by themselves.
SLOW = LEXICON | {"=" + "x" * 61}


def words_of(rnd, n):
    letters = [chr(c) for c in range(0x21, 0x300) if not chr(c).isspace()] + list("abcdeABCDE'-!.") * 30
    return PARTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def column(raws):
    return pa.array(raws, pa.binary()).view(pa.string())


def test_words_by_the_column():
    """Codes and terms of whole columns, as of each word; not all bytes are UTF-8."""
    raws = [w.encode() for w in words_of(random.Random(3), 20_000)] + [b"\xff\xfe", b"a\xc3", b"Snar\xe2\x82", b""]
    got = toxicity_trees.Coder(LEXICON, most=100)(toxicity_trees.Bare(column(raws)))
    assert got.tolist() == [toxicity_trees.word_code(w, LEXICON) for w in raws] and len(set(got.tolist())) > 8
    words = Words(column(raws))
    found, numbers = toxicity_trees.batch_terms(words, toxicity_trees.Memo(lambda w: toxicity_trees.terms(w.decode("utf-8", "replace"))))
    names = found.cast(pa.binary()).to_pylist()
    assert len(set(names)) == len([n for n in names if n is not None])
    for w, own in zip(words.words, numbers.T.tolist(), strict=True):
        assert {names[k] for k in own if k >= 0} == {t.encode() for t in toxicity_trees.terms(w.decode("utf-8", "replace"))}, w


@pytest.mark.parametrize("texts", [["", None], ["plain words"], ["漢字 漢字"]])
def test_columns_with_nothing_of_a_kind(texts):
    table = toxicity_trees.term_counts(pa.array(texts), np.zeros(len(texts), int), toxicity_trees.Memo(lambda w: toxicity_trees.terms(w.decode())), None)
    want = {t for text in texts for w in (text or "").split() for t in toxicity_trees.terms(w)}
    assert dict(zip(*(table.column(c).to_pylist() for c in ("term", "n0")), strict=True)) == dict.fromkeys(want, 1)
    words = Words(pa.array(texts))
    x = toxicity_trees.measured(words, toxicity_trees.Coder(LEXICON, most=100)(toxicity_trees.Bare(words.different))[words.which], [(t or "").encode() for t in texts])
    assert np.allclose(x, [slow_toxic_features(t or "", SLOW) for t in texts])


def test_features_of_neighbours():
    """Texts of one column: hits and words of the second person of one are nothing to the next."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice([" ", "\n", "\t "]) + rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 2, 5, 90]))) for _ in range(500)] + [None]
    words = Words(pa.array(texts))
    codes = toxicity_trees.Coder(LEXICON, most=100)(toxicity_trees.Bare(words.different))
    x = toxicity_trees.measured(words, codes[words.which], [(t or "").encode() for t in texts])
    for row, t in zip(x, texts, strict=True):
        assert np.allclose(row, slow_toxic_features(t or "", SLOW)), t


def test_no_python_for_each_plain_word(spark, monkeypatch):
    """Words of letters are coded and counted by the column: a corpus of new words costs no call each."""
    calls = []
    for name in ("word_code", "terms"):
        monkeypatch.setattr(toxicity_trees, name, lambda *a, f=getattr(toxicity_trees, name): calls.append(a) or f(*a))
    made = []
    monkeypatch.setattr(toxicity_trees, "map_batches", lambda df, schema, make: made.append(make))
    texts = [" ".join(f"{a}{b}{c}été," for c in "abcdefgh") for a in "abcd" for b in "efgh"] + ["gr0m"]
    toxicity_trees.score(spark.createDataFrame([(0, "a")], "doc_id long, text string"), {"lexicon": LEXICON, "trees": MagicMock(raw=lambda x: x[:, 0]), "steps": ([0, 1], [0, 1])}, ["doc_id"])
    assert made[0]()(pa.record_batch([pa.array(range(17)), pa.array(texts)], ["doc_id", "text"])).num_rows == 17
    rows = MagicMock()
    toxicity_trees._counted(rows, 1)
    (run, _), _ = rows.select.return_value.mapInArrow.call_args
    out = pa.Table.from_batches(run(iter([pa.record_batch([pa.array(texts), pa.array([0] * 17, pa.int32())], ["text", "half"])])))
    assert {t: n for t, n in zip(out["term"].to_pylist(), out["n0"].to_pylist(), strict=True)}["aeaété"] == 1
    assert len(calls) <= 2
