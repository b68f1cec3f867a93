import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attribix.llm import packing, prefix_bpe, token_shards
from attribix.llm.tokens import WordEncoder, crc_of

from .conftest import EDGES

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LETTERS = list("aZ é'ÉßÑñ ×÷5½́\n\t'sreÿŸ!|<>.ǅKſİ日​\x85\x1c") + ["the", "ing", "    ", "<|endoftext|>", "'ll"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return prefix_bpe.Vocabulary.load(BYTES)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return prefix_bpe.Encoder(vocabulary, public_tokenizers.PATTERN)


def noise(rng, most):
    return "".join(rng.choices(LETTERS, k=rng.randint(0, most)))


def test_words_as_the_library_gives_them(library, texts):
    encoder, rng = WordEncoder(WORDS, remembered=500), random.Random(5)
    for text in [t for _, t in texts] + [e[1] for e in EDGES] + [noise(rng, 40) for _ in range(1500)]:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library(text)
    assert len(encoder.words) <= 500


def test_crc_is_that_of_wide_ids():
    assert crc_of(np.array([1, 300], "<u2").tobytes(), "<u2") == zlib.crc32(np.array([1, 300], "<u4").tobytes())


def test_bpe_as_tiktoken(encoder, tik, texts):
    rng = random.Random(6)
    cases = [t for _, t in texts[:80]] + [e[1] for e in EDGES] + [noise(rng, 40) for _ in range(1500)]
    for text, ids in zip(cases, encoder.encode_all(cases), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text or "")
        assert encoder.decode(ids).decode() == (text or "")


def test_tokens_that_stay_apart(vocabulary):
    rng, ranks = random.Random(7), list(vocabulary.ranks.values())
    assert all(vocabulary.built(r) for r in ranks)
    for _ in range(4000):
        a, b = rng.choice(ranks[: rng.choice([400, 50_000])]), rng.choice(ranks[: rng.choice([400, 50_000])])
        assert vocabulary.stay_apart(a, b) == (vocabulary.merged(vocabulary.bytes_of[a] + vocabulary.bytes_of[b]) == [a, b])


def test_table_appends_and_edits(vocabulary):
    rng = random.Random(8)
    for _ in range(300):
        data = bytes(rng.choices(b"theinga rst", k=rng.randint(0, 60)))
        table = prefix_bpe.PrefixTable(vocabulary, data)
        more = bytes(rng.choices(b"theinga", k=rng.randint(0, 9)))
        table.append(more)
        data += more
        assert table.tokens() == vocabulary.merged(data) if data else table.tokens() == []
        upto = rng.randint(0, len(data))
        assert table.tokens(upto) == vocabulary.merged(data[:upto])
        a, b = sorted(rng.choices(range(len(data) + 1), k=2))
        table.replace(a, b, more)
        data = data[:a] + more + data[b:]
        fresh = prefix_bpe.PrefixTable(vocabulary, data)
        assert (table.last, table.size, table.tail) == (fresh.last, fresh.size, fresh.tail)


def test_an_edit_of_a_long_piece_is_local(vocabulary):
    data = b"thethingand" * 5000
    table = prefix_bpe.PrefixTable(vocabulary, data)
    assert table.replace(20_000, 20_003, b"xyz") < 2 * vocabulary.longest + 100
    assert table.tokens() == prefix_bpe.PrefixTable(vocabulary, data[:20_000] + b"xyz" + data[20_003:]).tokens()


def test_text_edits(encoder, tik):
    rng = random.Random(9)
    for _ in range(300):
        text = prefix_bpe.EncodedText(encoder, noise(rng, 50))
        for _ in range(4):
            a, b = sorted(rng.choices(range(len(text.text) + 1), k=2))
            text.replace(a, b, noise(rng, 5))
            assert text.tokens() == tik.encode_ordinary(text.text)
    long = prefix_bpe.EncodedText(encoder, "some words, " * 2000)
    assert long.replace(6000, 6003, "other") < 10
    assert long.append(" end") < 6
    assert long.tokens() == tik.encode_ordinary(long.text)


def test_encoded_rows(edges, make, tik):
    rows = prefix_bpe.encoded(edges, BYTES, public_tokenizers.PATTERN).collect()
    got = sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows)
    assert got == sorted((repr(e[0]), tik.encode_ordinary(e[1] or ""), (e[1] or "").encode()) for e in EDGES)
    assert prefix_bpe.encoded(make([]), BYTES, public_tokenizers.PATTERN).collect() == []


def shards(df, spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_shards.write(df, folder, WORDS)
    return folder


def test_shards_of_the_corpus(corpus, texts, llm, tmp_path, library):
    folder = shards(corpus.repartition(5), llm, tmp_path)
    rows = {r.doc_id: r for r in token_shards.read(token_shards.keys_of(corpus), folder).collect()}
    at = 0
    for doc, text in texts:
        ids = [*library(text), 1]
        assert np.frombuffer(rows[doc].ids, f"<u{rows[doc].width}").tolist() == ids
        assert (rows[doc].start, rows[doc].n_tokens) == (at, len(ids))
        at += len(ids)
    # A shard file can be read without the index: ids in ascending order, then lengths.
    store, root = token_shards.file_system(folder)
    whole = []
    for r in llm.read.parquet(f"{folder}/shards").orderBy("shard").collect():
        with store.open_input_file(f"{root}/{r.file}") as f:
            data = f.read()
        assert data[:7] == token_shards.MAGIC and data[7] == r.width
        n, total = np.frombuffer(data[-16:], "<u8").tolist()
        assert np.frombuffer(data[-16 - 4 * n : -16], "<u4").sum() == total == r.ids
        whole += np.frombuffer(data[8 : 8 + total * r.width], f"<u{r.width}").tolist()
    assert whole == [i for _, t in texts for i in [*library(t), 1]]
    # Keys that were not written are not found.
    strange = llm.createDataFrame([(d, 0) for d in range(10**6, 10**6 + 2000)] + [(texts[0][0], 1)], "doc_id long, nth int")
    assert token_shards.find(strange, folder).count() == 0


def test_shards_of_edges(edges, make, llm, tmp_path, library):
    folder = shards(edges, llm, tmp_path)
    rows = token_shards.read(token_shards.keys_of(edges), folder).collect()
    got = sorted((repr(r.doc_id), np.frombuffer(r.ids, f"<u{r.width}").tolist()) for r in rows)
    assert got == sorted((repr(e[0]), [*library(e[1]), 1]) for e in EDGES)
    assert sorted(r.nth for r in rows if r.doc_id == 5) == [0, 1, 2]
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id for r in ordered] == [None, None, 1, 2, 3, 4, 5, 5, 5, 6, 7]
    empty = f"file://{tmp_path}/empty"
    token_shards.write(make([]), empty, WORDS)
    assert token_shards.read(token_shards.keys_of(edges), empty).collect() == []


def test_a_doc_id_across_shards(make, llm, tmp_path):
    df = make([(3, f"word{i} x") for i in range(400)] + [(1, "a"), (9, "b")]).repartition(6)
    folder = shards(df, llm, tmp_path)
    rows = token_shards.read(token_shards.keys_of(df), folder).collect()
    assert sorted(r.nth for r in rows if r.doc_id == 3) == list(range(400))
    assert len({r.start for r in rows}) == 402


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_key_index(n):
    rng = np.random.default_rng(n)
    keys, marks = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    if n > 10:
        keys[:4] = keys[0]  # hashes that agree go to the list
    values = {c: np.arange(n) for c in ("shard", "n", "at", "start")}
    index = token_shards.KeyIndex.from_bytes(token_shards.KeyIndex.build(keys, marks, values).to_bytes())
    slots = index.find(keys, marks)
    assert sorted(slots.tolist()) == list(range(n))
    assert index.slots["at"][slots].tolist() == list(range(n))
    other = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    assert (index.find(*other) == -1).all()


def brute_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(corpus, texts, library):
    rows = packing.packed(corpus, WORDS, capacity=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for doc, text in texts:
        ids = [*library(text), 0]
        total += len(ids)
        parts = sorted(by[doc], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 256))
        assert [i for r in parts for i in np.frombuffer(r.ids, f"<u{r.width}").tolist()] == ids
        assert all(r.length == len(r.ids) // r.width for r in parts)
    assert brute_places(rows, 256) <= -(-total // 256) * 1.02 + 1


def test_packing_edges(edges, make):
    rows = packing.packed(edges, WORDS).collect()
    assert sorted(repr(r.doc_id) for r in rows if r.piece == 0) == sorted(repr(e[0]) for e in EDGES)
    brute_places(rows, packing.CAPACITY)
    assert packing.packed(make([]), WORDS).collect() == []


def test_one_length_for_all(make):
    rows = packing.packed(make([(i, "one two three") for i in range(1000)]), WORDS, capacity=10).collect()
    assert brute_places(rows, 10) == 500


def test_two_fit_beats_greedy():
    """Greedy puts 6 + 3 into 10; 6 + 2 + 2 is tighter and leaves 3 + 7."""
    found = list(packing.bins({7: 1, 6: 1, 3: 1, 2: 2}, 10))
    assert sum(n for n, _ in found) == 2
    rng = random.Random(3)
    better = 0
    for _ in range(200):
        counts = {x: rng.randint(1, 9) for x in rng.sample(range(1, 51), rng.randint(1, 20))}
        left, greedy = dict(counts), 0
        while any(left.values()):
            gap, greedy = 50, greedy + 1
            for x in sorted(left, reverse=True):
                n = min(left[x], gap // x)
                left[x] -= n
                gap -= n * x
        for found in (packing.fewest(counts, 50), list(packing.bins(counts, 50))):
            used = dict.fromkeys(counts, 0)
            for repeats, content in found:
                assert repeats > 0 and 0 < sum(x * n for x, n in content.items()) <= 50
                for x, n in content.items():
                    used[x] += n * repeats
            assert used == counts
        bins = sum(n for n, _ in packing.fewest(counts, 50))
        assert bins <= greedy
        better += bins < greedy
    assert better


def test_fingerprints_are_apart_from_the_bucket():
    """Keys of one of 2^14 buckets: foreign keys of the bucket are told apart by all 32 bits of the fingerprint."""
    rng = np.random.default_rng(2)

    def draw(n):
        keys = rng.integers(0, 1 << 64, n, np.uint64) & ~np.uint64((1 << 14) - 1) | np.uint64(77)
        return keys, rng.integers(0, 1 << 64, n, np.uint64)

    keys, marks = draw(2_000)
    values = {c: np.arange(2_000) for c in ("shard", "n", "at", "start")}
    index = token_shards.KeyIndex.build(keys, marks, values)
    assert sorted(index.find(keys, marks).tolist()) == list(range(2_000))
    assert (index.find(*draw(1_000_000)) >= 0).sum() <= 1


def test_the_bucket_leaves_the_fingerprint_alone(llm):
    """Over many buckets the fingerprints of a bucket's keys differ in their lowest bits."""
    keyed = llm.range(40_000).select(*[c.alias(n) for n, c in token_shards._key(F.col("id"), F.lit(0)).items()])
    rows = keyed.where(F.pmod("key", F.lit(1 << 6)) == 5).select((F.col("mark") % 64).alias("m")).distinct().count()
    assert rows > 50
