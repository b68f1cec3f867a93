"""Byte-level BPE by a table of last tokens.

For every prefix of a piece there is exactly one token that can end its encoding. It is found from the shorter
prefixes: a token fits at the end if the prefix before it ends in a token that the two merge rules leave apart from it.
The table of last tokens is all that is stored: reading it backwards gives the encoding of any prefix. Appending bytes
only adds entries. After an edit, entries before it stay; those behind it are made anew until as many in a row as the
longest token has bytes agree with the old ones, from where on nothing can differ.

A text is first cut into pieces by the pattern of the vocabulary, and each piece is encoded on its own; a piece that is
a token as a whole is that token.

Defined results: a null text is an empty one and has no ids. Rows are encoded one by one, so repeated rows and null
doc_ids come out as they went in. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import takes_over

#: Pieces a worker remembers at most. The frequent ones come early, so full memory is left as it
#: is until it has failed ``STALE`` times as often; then it starts anew.
REMEMBERED = 300_000
STALE = 8
PAIRS = 500_000
#: Characters of text whose pieces are held at a time.
CHUNK = 1 << 18


class Vocabulary:
    """Ranks of byte strings, and the merge rules as far as the table needs them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.heads = {t[: i + 1] for t in ranks for i in range(len(t))}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.ends: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """Encoding by the merge rules themselves, the pair of lowest rank first; stops at ``until`` parts."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            low = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[low] + parts[low + 1] not in ranks:
                break
            parts[low : low + 2] = [parts[low] + parts[low + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None of a single byte, and of a token the rules never build."""
        if token not in self.split:
            data, pair = self.bytes_of[token], None
            if len(data) > 1:
                parts = self.merged(data, 2)
                pair = (parts[0], parts[1]) if len(parts) == 2 else None
            self.split[token] = pair
        return self.split[token]

    def built(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes.

        The merges inside the two are undone from the highest rank down. If at any point the parts that touch would
        have merged with each other before the merge undone last, the border between the two tokens would not be there.
        """
        key = (left, right)
        if (known := self.apart.get(key)) is not None:
            return known
        bytes_of, ranks = self.bytes_of, self.ranks
        limit, known = 1 << 60, True
        a, b = left, right
        while True:
            joint = ranks.get(bytes_of[a] + bytes_of[b])
            if joint is not None and joint < limit:
                known = False
                break
            inner_a, inner_b = self.halves(a), self.halves(b)
            if inner_a is None and inner_b is None:
                break
            if inner_b is None or (inner_a is not None and a > b):
                limit, a = a, inner_a[1]  # of equal ranks the left pair merges first
            else:
                limit, b = b + 1, inner_b[0]
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[key] = known
        return known

    def endings(self, tail: bytes) -> tuple[tuple[int, int], ...]:
        """(token, length) of every token that ends ``tail``, the longest first."""
        if (known := self.ends.get(tail)) is None:
            found = [(self.ranks[tail[i:]], len(tail) - i) for i in range(len(tail)) if tail[i:] in self.ranks]
            known = self.ends[tail] = tuple(x for x in found if self.built(x[0]))
        return known


class PrefixTable:
    """Last token of every prefix of one piece; ``last[i]`` belongs to the prefix of i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []
        self.size: list[int] = []
        self.tail: list[int] = []
        self.append(data)

    def cut(self, at: int) -> None:
        """Forget all prefixes longer than ``at``."""
        del self.last[at:], self.size[at:], self.tail[at:]

    def fill(self, upto: int) -> None:
        """Entries up to the prefix of ``upto`` bytes. ``tail[i]`` is the length of its longest end that begins a token."""
        v, data, last, size, tail = self.vocabulary, self.data, self.last, self.size, self.tail
        heads, ends, apart = v.heads, v.ends, v.apart
        at = len(last)
        reach = tail[-1] if at else 0
        while at < upto:
            at += 1
            reach += 1
            while (end := data[at - reach : at]) not in heads:
                reach -= 1
                if not reach:
                    raise ValueError(f"no token holds byte {data[at - 1]}")
            for token, length in ends.get(end) or v.endings(end):
                if length < at:
                    before = last[at - length - 1]
                    known = apart.get((before, token))
                    if not (v.stay_apart(before, token) if known is None else known):
                        continue
                last.append(token)
                size.append(length)
                tail.append(reach)
                break
            else:
                raise ValueError(f"no token ends {data[:at]!r}")

    def append(self, more: bytes) -> None:
        self.data += more
        self.fill(len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to end; returns how many entries were made anew."""
        old, shift = (self.last, self.size, self.tail), len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, self.size, self.tail = (x[:start] for x in old)
        same = 0
        for at in range(start, len(self.data)):
            self.fill(at + 1)
            was = at - shift
            now = (self.last[at], self.size[at], self.tail[at])
            same = same + 1 if at >= start + len(new) and tuple(x[was] for x in old) == now else 0
            if same >= self.vocabulary.longest:
                for mine, was_mine in zip((self.last, self.size, self.tail), old, strict=True):
                    mine += was_mine[was + 1 :]
                return at + 1 - start
        return len(self.data) - start

    def tokens(self, upto: int | None = None) -> list[int]:
        """Encoding of the first ``upto`` bytes by the merge rules."""
        at, out = len(self.data) if upto is None else upto, []
        while at:
            out.append(self.last[at - 1])
            at -= self.size[at - 1]
        return out[::-1]


class Encoder:
    """Whole texts, piece by piece. ``pattern`` cuts a text without gaps."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.missed = 0

    def piece(self, data: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, data).tokens()

    def _packed(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of new pieces. In sorted order each keeps the table of the prefix it shares with the one before."""
        v, table, out = self.vocabulary, PrefixTable(self.vocabulary), {}
        ranks, last, size = v.ranks, table.last, table.size
        for text in sorted(pieces):
            data = text.encode()
            whole = ranks.get(data)
            if whole is not None:
                out[text] = whole.to_bytes(4, "little")
                continue
            n = len(commonprefix((data, table.data)))
            if n < len(last):
                table.cut(n)
            table.data = data
            table.fill(len(data))
            at, found = len(data), []
            while at:
                found.append(last[at - 1].to_bytes(4, "little"))
                at -= size[at - 1]
            found.reverse()
            out[text] = b"".join(found)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; new pieces of about ``CHUNK`` characters are encoded together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            if text and len(text) <= CHUNK:
                held.append((i, self.pattern.findall(text)))
                size += len(text)
            else:
                pieces = self.pattern.finditer(text or "")
                while part := [m[0] for m in islice(pieces, CHUNK // 4)]:
                    held.append((i, part))
                    self._flush(held, out)
            if size >= CHUNK:
                self._flush(held, out)
                size = 0
        self._flush(held, out)
        return [b"".join(parts) for parts in out]

    def _flush(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        known = self.known
        made = self._packed({p for _, pieces in held for p in pieces if p not in known})
        for i, pieces in held:
            out[i].append(b"".join([known.get(p) or made[p] for p in pieces]))
        held.clear()
        room = REMEMBERED - len(known)
        if room > 0:
            known.update((p, made[p]) for p in islice(made, room) if len(p) <= 64)
        else:
            self.missed += len(made)
            if self.missed > STALE * REMEMBERED:
                known.clear()
                self.missed = 0

    def decode(self, ids: bytes) -> bytes:
        get = self.vocabulary.bytes_of
        return b"".join([get[i] for i in np.frombuffer(ids, "<u4").tolist()])


class EncodedText:
    """A text whose encoding follows edits: only the pieces around an edit are cut and encoded anew."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.starts, self.ids = self._cut(text, 0)

    def _cut(self, text: str, at: int) -> tuple[list[int], list[list[int]]]:
        starts, ids = [], []
        for m in self.encoder.pattern.finditer(text, at):
            starts.append(m.start())
            ids.append(self.encoder.piece(m[0].encode()))
        return starts, ids

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of characters start to end; returns how many pieces were encoded anew.

        A piece looks at most one character past its end, and only a run of white space can be cut shorter by what
        follows it; so cutting starts two pieces before the one that holds the edit. From a border behind the edit
        that is also an old one, all later pieces are the old ones.
        """
        shift, text = len(new) - (end - start), self.text[:start] + new + self.text[end:]
        first = max(0, bisect_right(self.starts, start) - 3)
        at = self.starts[first] if self.starts else 0
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, ids = [], []
        rest = len(self.starts)
        for m in self.encoder.pattern.finditer(text, at):
            if m.start() >= start + len(new) and (i := old.get(m.start())) is not None:
                rest = i
                break
            starts.append(m.start())
            ids.append(self.encoder.piece(m[0].encode()))
        self.text = text
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[rest:]]
        self.ids = self.ids[:first] + ids + self.ids[rest:]
        return len(starts)

    def tokens(self) -> list[int]:
        return [t for piece in self.ids for t in piece]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    takes_over("bytes", _encoders.clear)
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _encoders[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary, from the ids) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            ids = e.encode_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([e.decode(x) for x in ids], pa.binary())],
                names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids binary, decoded binary")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
