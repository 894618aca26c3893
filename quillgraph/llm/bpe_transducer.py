"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

Encoding.  For any byte string the BPE encoding of each prefix ends in exactly one
token, and a token sequence is the encoding of its bytes if and only if every two
neighbours are (the encoding of their joined bytes is those two tokens).  So the last
token of each prefix follows from the last tokens of shorter prefixes.  A state holds
the bytes read since the last certain token boundary and the last token at those
positions in it where a longer token may still begin; as soon as all such positions
agree on the tokens before them, these are emitted.  The lookahead is thus bounded by
the length of the longest token.  States and transitions are made lazily: when first asked
for, the rest of the piece is encoded by the same rule without a state; asked for again, the
transition is made and kept.

Decoding.  Ids become bytes, and an incremental UTF-8 state machine turns chunks of
bytes into text, holding back the bytes of an unfinished character.

Defined cases: null and empty texts give no ids and the digests of no bytes; rows with
equal or null ids are encoded one by one; an empty table gives no rows; very long texts are
decoded in chunks of ``CHUNK`` ids; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import Memo, map_batches, texts

#: White space by Unicode, as the split pattern means it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Stretches that no match of the split pattern crosses.
_STRETCH = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


_BYTES = [bytes((k,)) for k in range(256)]

#: States that a transducer holds, and measure of the memos; memory and time go opposite ways.
MOST_STATES = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _merge_last(ranks: dict[bytes, int], piece: bytes) -> tuple[list[int], tuple[bytes, bytes] | None]:
    """Plain BPE: join the neighbours of lowest rank, leftmost first.  Also the parts of the last join."""
    parts, last = [piece[i : i + 1] for i in range(len(piece))], None
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [last[0] + last[1]]
    return [ranks[p] for p in parts], last


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    return _merge_last(ranks, piece)[0]


class Transducer:
    """States are numbers; ``step`` reads a byte and ``finish`` emits what is pending.

    A state is (bytes read since the last certain boundary, last token at each position or
    None, positions where a longer token may begin).  States and transitions are held in two
    generations of ``most_states / 2`` states: when the young one is full it becomes the old
    one, and what is met again moves back with its number, so frequent states stay.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self._made: dict[bytes, tuple] = {}
        self._fits: dict[int, bool] = {}
        self._grows: dict[tuple[int, bytes], bool] = {}
        self.longer: dict[bytes, list[int]] = {}  # proper prefixes of the tokens that merges make
        for t, i in ranks.items():
            if self.made(t)[0]:
                for k in range(1, len(t)):
                    self.longer.setdefault(t[:k], []).append(i)
        self.ids = {t: i for t, i in ranks.items() if self.made(t)[0]}
        #: Of tokens whose merges come in order of rank: rank of the last merge (-1: none), and its two parts.
        self.level = {t: self.ranks[t] if len(t) > 1 else -1 for t in self.ids if self.made(t)[2]}
        self.parts = {t: self.made(t)[1] for t in self.level}
        self.asked: set[int] = set()  # transitions that were asked for once
        self._shorter: dict[int, int | None] = {}
        self._count = 0
        self._old: tuple[dict, dict, dict] = ({}, {}, {})
        self._begin()

    def _begin(self) -> None:
        self.states: dict[int, tuple] = {}
        self.number: dict[tuple, int] = {}
        self.next: dict[int, int | tuple] = {}  # a state; with what is emitted, if anything is
        self.start = self._state((b"", (None,), ()))

    def _turn(self) -> None:
        """The young generation becomes the old one."""
        self._old = (self.states, self.number, self.next)
        self._begin()

    def _state(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self._old[1].get(state)
            if n is None:
                n, self._count = self._count, self._count + 1
            self.number[state] = n
            self.states[n] = state
        return n

    def made(self, t: bytes) -> tuple:
        """(do the merges make this token?, its last merge's two parts, are all ranks on the way lower?)"""
        v = self._made.get(t)
        if v is None:
            if len(t) == 1:
                v = (True, None, True)
            else:
                ids, last = _merge_last(self.ranks, t)
                if len(ids) > 1:
                    v = (False, None, False)
                else:
                    parts = [self.made(x) for x in last]
                    below = max(self.ranks[x] if len(x) > 1 else -1 for x in last) < ids[0]
                    v = (True, last, below and all(x[0] and x[2] for x in parts))
            self._made[t] = v
        return v

    def fits(self, a: int, b: int) -> bool:
        """Is the encoding of the two tokens' joined bytes these two tokens?"""
        key = a << 32 | b
        v = self._fits.get(key)
        if v is None:
            if len(self._fits) > 5 * self.most_states // 2:
                self._fits.clear()
            x, y = self.token[a], self.token[b]
            v = self._fits[key] = self._apart(x, y) if x in self.level and y in self.level else merge(self.ranks, x + y) == [a, b]
        return v

    def _apart(self, x: bytes, y: bytes) -> bool:
        """Undo the merges at the border, latest first: could one across it have come before?"""
        rank, level, parts, before = self.ranks.get, self.level, self.parts, 1 << 62
        of_x, of_y = level[x], level[y]
        while True:
            r = rank(x + y)
            if r is not None and r < before:
                return False
            if of_x > of_y:
                before, x = of_x, parts[x][1]
                of_x = level[x]
            elif of_y < 0:
                return True
            else:
                before, y = of_y + 1, parts[y][0]
                of_y = level[y]

    def grows(self, before: int | None, t: bytes, many: int = 20) -> bool:
        """May a longer token begin with these bytes, after the token before them?"""
        found = self.longer.get(t)
        if found is None:
            return False
        if before is None or len(found) > many:
            return True
        v = self._grows.get((before, t))
        if v is None:
            if len(self._grows) > 5 * self.most_states // 4:
                self._grows.clear()
            v, fits = False, self.fits
            for i in found:
                if fits(before, i):
                    v = True
                    break
            self._grows[before, t] = v
        return v

    def _way(self, last: tuple, p: int) -> int:
        """Bit set of the boundaries on the way to a position."""
        size, way = self.size, 1
        while p:
            way |= 1 << p
            p -= size[last[p]]
        return way

    def _make(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        held, last, begins = self.states[at]
        held += _BYTES[byte]
        n, ids, longer, fits, live, token = len(held), self.ids, self.longer, self._fits, [], None
        for p in (*begins, n - 1):
            before, t = last[p], held[p:]
            if t in longer and self.grows(before, t):
                live.append(p)
            if token is None:
                i = ids.get(t)
                if i is not None:
                    ok = before is None or fits.get(before << 32 | i)
                    if self.fits(before, i) if ok is None else ok:
                        token, way = i, self._way(last, p) | 1 << n
        if token is None:
            raise ValueError("the ranks do not hold every single byte")
        common = kept = way
        for p in live:
            w = self._way(last, p)
            common &= w
            kept |= w
        cut = common.bit_length() - 1
        last = (*last, token)
        out = self._back(last, cut)
        if cut:
            held, last, kept = held[cut:], last[cut:], kept >> cut
            live = [p - cut for p in live]
        # the last token before the cut matters at the first position only
        n = kept.bit_length()
        last = tuple([t if kept >> p & 1 else None for p, t in enumerate(last)]) if kept + 1 != 1 << n else last
        return self._state((held, last, tuple(live))), tuple(out)

    def step(self, at: int, byte: int) -> int | tuple[int, tuple[int, ...]] | None:
        """The next state; if something is certain by now, also that.  None when first asked."""
        key = at << 8 | byte
        to = self.next.get(key)
        if to is None:
            to = self._old[2].get(key)
            if to is None:
                if key not in self.asked:
                    if len(self.asked) > self.most_states:
                        self.asked.clear()
                    self.asked.add(key)
                    return None
                to, out = self._make(at, byte)
                if out:
                    to = (to, out)
            else:
                n = to if to.__class__ is int else to[0]
                state = self.states[n] = self._old[0][n]
                self.number[state] = n
            self.next[key] = to
        return to

    def _longest(self, data: bytes, at: int) -> int:
        """The longest token that begins at a place."""
        ids, longer, end = self.ids.get, self.longer, at + 1
        t = data[at:end]
        found = ids(t)
        if found is None:
            raise ValueError("the ranks do not hold every single byte")
        while t in longer and end < len(data):
            end += 1
            t = data[at:end]
            i = ids(t)
            if i is not None:
                found = i
        return found

    def _next_shorter(self, i: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        v = self._shorter.get(i, -1)
        if v == -1:
            t = self.token[i]
            v = self._shorter[i] = next((x for k in range(len(t) - 1, 0, -1) if (x := self.ids.get(t[:k])) is not None), None)
        return v

    def rest(self, at: int, tail: bytes) -> list[int]:
        """The tokens of what a state holds and of the bytes after it, without new states.

        Longest tokens first, shorter ones where neighbours do not fit, and back where none does.
        Neighbours that all fit are the encoding, and a prefix has one encoding only, so a place
        from which there was no way on is never tried again.
        """
        held, last, _ = self.states[at]
        data, first, dead = held + tail, last[0], set()
        size, known, fits = self.size, self._fits.get, self.fits
        out: list[int] = []
        p, n = 0, len(data)
        if not n:
            return out
        token = self._longest(data, 0)
        while True:
            before = out[-1] if out else first
            end = p + size[token]
            if end not in dead:
                ok = before is None or known(before << 32 | token)
                if fits(before, token) if ok is None else ok:
                    out.append(token)
                    if end == n:
                        return out
                    p, token = end, self._longest(data, end)
                    continue
            token = self._next_shorter(token)
            while token is None:
                dead.add(p)
                if not out:
                    raise ValueError("the ranks do not hold every single byte")
                back = out.pop()
                p -= size[back]
                token = self._next_shorter(back)

    def _back(self, last: list | tuple, p: int) -> list[int]:
        out, size = [], self.size
        while p:
            out.append(last[p])
            p -= size[last[p]]
        return out[::-1]

    def finish(self, at: int) -> list[int]:
        """The tokens that are pending when a piece ends."""
        held, last, _ = self.states[at]
        return self._back(last, len(held))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most_states // 2:
            self._turn()
        at, ids, known = self.start, [], self.next.get
        for k, byte in enumerate(piece):
            to = known(at << 8 | byte)
            if to is None:
                to = self.step(at, byte)
                if to is None:
                    return ids + self.rest(at, piece[k:])
            if to.__class__ is int:
                at = to
            else:
                at, out = to
                ids += out
        ids += self.finish(at)
        return ids


class Utf8Stream:
    """Incremental UTF-8: ``feed`` gives the text of all finished characters."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end belong to a character that is not finished."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if byte >> 5 == 0b110 else 3 if byte >> 4 == 0b1110 else 4 if byte >> 3 == 0b11110 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Texts to ids and back, with bounded memos of pieces and of stretches between white space."""

    #: Ids that are decoded at a time.
    CHUNK = 65_536

    def __init__(self, path: str, pattern: str, most_states: int = MOST_STATES):
        self.ranks = load_ranks(path)
        self.transducer = Transducer(self.ranks, most_states)
        self.pieces = regex.compile(pattern)
        self.of_id: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.of_id[i] = t
        self._stretch = Memo(self._encode, most=3 * most_states)
        self._piece = Memo(lambda p: little(self.transducer.encode(p.encode())), most=2 * most_states)

    def _encode(self, stretch: str) -> bytes:
        pieces = self.pieces.findall(stretch)
        return self._piece[pieces[0]] if len(pieces) == 1 else b"".join(map(self._piece.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._stretch.__getitem__, _STRETCH.findall(text)))

    def decode(self, ids: bytes) -> Iterator[str]:
        """The text in chunks, by the incremental UTF-8 state machine."""
        many, stream = np.frombuffer(ids, "<u4"), Utf8Stream()
        for k in range(0, len(many), self.CHUNK):
            yield stream.feed(b"".join(map(self.of_id.__getitem__, many[k : k + self.CHUNK].tolist())))
        yield stream.close()


_CODECS: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, most_states: int = MOST_STATES) -> Codec:
    """One codec a worker process: its states serve all tasks there."""
    key = (path, pattern, most_states)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode_decode(docs: DataFrame, path: str, pattern: str, most_states: int = MOST_STATES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars of the decoded text."""

    def make():
        c = codec(path, pattern, most_states)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b, chars = [], [], [], []
            for ids in map(c.encode, texts(batch)):
                sha, k = hashlib.sha256(), 0
                for part in c.decode(ids):
                    sha.update(part.encode())
                    k += len(part)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(sha.hexdigest())
                chars.append(k)
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(chars, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

        return run

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long", make)
