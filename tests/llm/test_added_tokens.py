"""Added tokens that a text names, as the library gives them by default."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from attribix.llm import packing, token_shards
from attribix.llm.tokens import word_encoder

from .test_tokens import LETTERS

WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*LETTERS, "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", "word"]


def ids_of(text):
    return Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_words():
    rng, library, encoder = random.Random(11), Tokenizer.from_file(WORDS), word_encoder(WORDS)
    for text in ["a <|endoftext|> b", "a<|endoftext|>b", *("".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3000))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == want, text
    assert ids_of("a <|endoftext|> b") == [320, 49407, 321]


def test_shards_and_packing(make, tmp_path):
    texts = {1: "a <|endoftext|> b", 2: "x<|startoftext|>y z"}
    df, folder = make(list(texts.items())), f"file://{tmp_path}/tokens"
    token_shards.write(df, folder, WORDS)
    shards = {r.doc_id: r for r in token_shards.read(token_shards.keys_of(df), folder).collect()}
    packed = {r.doc_id: r for r in packing.packed(df, WORDS).collect()}
    for doc, text in texts.items():
        assert np.frombuffer(shards[doc].ids, f"<u{shards[doc].width}").tolist() == [*ids_of(text), 1]
        assert np.frombuffer(packed[doc].ids, f"<u{packed[doc].width}").tolist() == [*ids_of(text), 0]
