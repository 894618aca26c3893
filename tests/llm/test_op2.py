import io
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from quillgraph.llm.token_planes import ShardReader, ShardWriter, WordEncoder, from_planes, read_shards, to_planes, write_shards
from tests.llm.data import ODD, empty, odd

PATH = P.path("word_bpe_49k.json")


def test_planes():
    rnd = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rnd.integers(0, 2**32, n, dtype=np.uint32)
        for bits in (False, True):
            assert (from_planes(to_planes(ids, bits), n, bits) == ids).all()


def test_shard():
    rnd = np.random.default_rng(2)
    docs = [(None if k == 3 else k, rnd.integers(0, 49408, size, dtype=np.uint32).tobytes()) for k, size in enumerate([0, 1, 200_000, 5, 65_536, 0])]
    for bits in (False, True):
        f = io.BytesIO()
        w = ShardWriter(f, bits)
        for d in docs:
            w.add(*d)
        w.close()
        assert list(ShardReader(f.getvalue()).documents()) == docs


def test_words_are_the_text():
    t, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    for text in ["", " a  b\n", "Ça va? It's 12.5% — naïve x́ <|endoftext|>a é ΑΣ ΣΑΣ\x85b\x1cc", *[x[1] or "" for x in ODD]]:
        assert np.frombuffer(e(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_are_those_of_the_library():
    t, e = Tokenizer.from_file(PATH), WordEncoder(PATH)
    letters = [chr(c) for c in range(1, 0x310)]
    ends = ["'s", "'T", "'re", "'vE", "'m", "'LL", "'d", "'r", "'l", "'", "''s", "'s's", "'resolve", "'sé", "'²", "a'", "-'s", "é'S", "'ſ", "12'm3", "</w>", "'\u00ad"]
    texts = [*letters, *("a" + c + "B" for c in letters), *("1" + c + c + "." for c in letters), *ends, *("Word" + x for x in ends), " ".join(ends), "' s 'r e", None, "", "x" * 100 + " " + "x" * 100]
    rnd = np.random.default_rng(3)
    some = [*"aZ1.'<|>_ \n\0éµ½Ⱥſ\u0130\u0301漢", "'s", "'LL", "re"]
    texts += ["".join(some[k] for k in rnd.integers(0, len(some), n)) for n in rnd.integers(1, 30, 3000)]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    small = WordEncoder(PATH, most=100)  # generations come and go
    for _ in range(2):  # new pieces, then known ones
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(column)] == want
        assert [np.frombuffer(x, "<u4").tolist() for k in range(0, len(column), 50) for x in small.encode(column.slice(k, 50))] == want
    assert list(e.encode(column.slice(0, 0))) == []


def test_new_words_cost_no_call_each():
    e = WordEncoder(PATH)
    list(e.encode(pa.array(["a first text, that isn't counted"])))
    column, calls = pa.array([" ".join(f"x{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000]}," for k in range(5000))]), 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        list(e.encode(column))
    finally:
        sys.setprofile(None)
    assert calls < 1000


def test_other_files_are_not_taken_for_this_one(tmp_path):
    import json

    spec = json.load(open(PATH))
    assert WordEncoder(PATH).fast
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}]}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    t, e = Tokenizer.from_file(str(tmp_path / "other.json")), WordEncoder(str(tmp_path / "other.json"))
    assert not e.fast
    for text in ("Ça  va", "naïve\tword", ""):
        assert np.frombuffer(e(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_query(spark):
    t = Tokenizer.from_file(PATH)
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for d, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for kw in ({}, {"bits": True, "ids_per_shard": 10}):
        got = [tuple(r) for r in read_shards(write_shards(odd(spark), PATH, 1, **kw)).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert read_shards(write_shards(empty(spark), PATH, 1)).count() == 0
