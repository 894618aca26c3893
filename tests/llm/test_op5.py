import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from quillgraph.llm.bpe_transducer import Codec, Transducer, Utf8Stream, encode_decode, merge
from tests.llm.data import ODD, empty, odd

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_against_library():
    c = Codec(PATH, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rnd, tokens = random.Random(5), list(c.ranks)
    alphabet = "abcdeé漢字ñ😀'  \n\t12.,!\x1c\x85\xa0　sStTrRveEllmM"
    for _ in range(1500):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert np.frombuffer(c.encode(t), "<u4").tolist() == lib.encode_ordinary(t)
        t = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 8))).decode("utf8", "ignore")
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert "".join(c.decode(ids)) == t


def test_transducer_on_odd_ranks():
    """Ranks under which some tokens cannot be made, and parts rank above their whole."""
    rnd = random.Random(3)
    for _ in range(60):
        ranks = {bytes((k,)): k for k in range(256)}
        while len(ranks) < 300:
            t = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5)))
            ranks.setdefault(t, 256 + rnd.randint(0, 10_000) * 100 + len(ranks))
        tr = Transducer(ranks, most_states=50)
        for _ in range(40):
            t = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 25)))
            assert tr.encode(t) == ([ranks[t]] if t in ranks else merge(ranks, t))


def test_stream():
    text = "aé漢😀z" * 3
    for size in (1, 2, 3, 5):
        s, data = Utf8Stream(), text.encode()
        assert "".join([s.feed(data[k : k + size]) for k in range(0, len(data), size)] + [s.close()]) == text


def test_query(spark):
    rows = encode_decode(odd(spark), PATH, P.PATTERN).collect()
    assert len(rows) == len(ODD)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=Codec(PATH, P.PATTERN).ranks, special_tokens={})
    want = sorted((i or 0, len(x := lib.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert encode_decode(empty(spark), PATH, P.PATTERN).count() == 0
