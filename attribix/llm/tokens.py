"""Whole texts to token ids with a word tokenizer of the tokenizers library, one instance for each Python worker.

The vocabulary drops white space and never merges across it, so a text's ids are those of its words in a row. Words
come back often, so each worker remembers what the library gave for them; the memory is bounded.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

from .shared import takes_over

#: Words and letter runs a worker remembers at most. The frequent ones come early, so a full memory is left as it is
#: until it has failed ``STALE`` times as often; then it starts anew.
REMEMBERED = 300_000
STALE = 8

#: Words of these characters are their own normal form but for case, and split into runs by the simple pattern below.
#: The apostrophe is left out, as it takes part in contractions.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """Printable letter of each byte, in the way byte-level vocabularies write them: bytes without one follow at 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids as the library gives them with ``add_special_tokens=False``.

    With ``added`` the names of added tokens in a text are those tokens, which is the library's default; without, they
    are plain text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.remembered, self.missed = remembered, 0
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _keep(self, memory: dict, key, ids: bytes) -> bytes:
        if len(memory) < self.remembered:
            memory[key] = ids
        else:
            self.missed += 1
            if self.missed > STALE * self.remembered:
                self.words.clear()
                self.runs.clear()
                self.missed = 0
        return ids

    def _run(self, run: str) -> bytes:
        letters = self.letters
        shown = run if run.isascii() else "".join([letters[b] for b in run.encode()])
        ids = self.model.tokenize(shown)
        return self._keep(self.runs, run, np.array([t.id for t in ids], self.dtype).tobytes() if len(ids) > 1 else self.end(ids[0].id))

    def _names_added(self, text: str) -> bool:
        low = text.lower() if self.added else ""
        return any(name in low for name in self.added)

    def _word(self, word: bytes) -> bytes:
        runs = self.runs
        if word.isalpha():
            run = word.lower().decode()
            ids = runs.get(run) or self._run(run)
        elif _PLAIN.fullmatch(text := word.decode()) and not self._names_added(text):
            ids = b"".join([runs.get(r) or self._run(r) for r in _RUNS.findall(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return self._keep(self.words, word, ids) if len(word) <= 64 else ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, without special tokens, as little-endian integers of ``dtype``."""
        get, word = self.words.get, self._word
        return b"".join([ids if (ids := get(w)) is not None else word(w) for w in (text or "").encode().split()])

    def end(self, token: int) -> bytes:
        return token.to_bytes(self.dtype.itemsize, "little")


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder of the vocabulary file."""
    takes_over("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, added=True)
    return _encoders[path]


def crc_of(ids: bytes, dtype: np.dtype | str) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())
