"""Encoding, counts and the id store against the libraries and brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetcohort.llm import idstore, sentencepiece, wordpiece
from fleetcohort.llm.common import tokenizer_file
from tests.llm.helpers import ROWS, documents

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
ODD = list("aabbcde  théñ日🙂\n\t▁́xyz<>.,'İıſª½") + ["the", "ing", "  ", "'s", "<|endoftext|>"]


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece as public

    return public.SentencePieceProcessor(model_file=PIECES)


def test_merge_rounds_equal_the_library(library):
    model = sentencepiece.load(PIECES)
    texts = [*odd_texts(3000), "a" * 3000, "ab" * 2000, "ha" * 500 + "  " * 40, ""]
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode([*ids, 2]) == library.decode([*ids, 2])


def test_decoding_any_ids_equals_the_library(library):
    rng, model = random.Random(1), sentencepiece.load(PIECES)
    for _ in range(2000):
        ids = [
            rng.choice([3 + rng.randrange(256), rng.randrange(32000), 28705, 0, 1, 2])
            for _ in range(rng.randint(0, 6))
        ]
        assert model.decode(ids) == library.decode(ids)


def test_sentencepiece_table(spark, library):
    got = sentencepiece.encode_decode(documents(spark), PIECES).collect()
    assert [r["doc_id"] for r in got] == [k for k, _ in ROWS]
    for (_, text), row in zip(ROWS, got, strict=True):
        ids = [*library.encode(text or ""), 2]
        assert row["ids"] == ids
        assert row["decoded"] == library.decode(ids)
    assert sentencepiece.encode_decode(documents(spark, []), PIECES).count() == 0


def greedy(word, starts, rest):
    at, n = 0, 0
    while at < len(word):
        vocabulary = starts if at == 0 else rest
        for end in range(min(len(word), at + 32), at, -1):
            if word[at:end] in vocabulary:
                at, n = end, n + 1
                break
        else:
            return -1
    return n


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(2)
    for _ in range(60):
        letters = "abc"
        make = lambda n: {"".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(n)}
        starts, rest = make(rng.randint(0, 8)), make(rng.randint(0, 8))
        automaton = wordpiece.CountAutomaton(starts, rest)
        words = ["".join(rng.choices(letters + "d", k=rng.randint(1, 9))) for _ in range(80)]
        assert automaton.counts(words).tolist() == [greedy(w, starts, rest) for w in words]


def test_token_counts_table(spark):
    starts, rest = map(set, wordpiece.vocabulary(PIECES))
    got = wordpiece.token_counts(documents(spark), PIECES).collect()
    for (key, text), row in zip(ROWS, got, strict=True):
        words = wordpiece.split_words(text or "")
        counts = [greedy(w, starts, rest) for w in words]
        assert row["doc_id"] == key
        assert row["n_words"] == len(words)
        assert row["n_unknown"] == counts.count(-1)
        assert row["n_pieces"] == sum(1 if c < 0 else c for c in counts)
    assert wordpiece.token_counts(documents(spark, []), PIECES).count() == 0


def test_word_by_word_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    texts = [*odd_texts(3000, 9), "Erst.,., Été!, ÉTÉ <|ENDOFTEXT|> <|endoftext|>.", ""]
    for text, ids in zip(texts, idstore.encode_texts(WORDS, texts, 2, 2), strict=True):
        expect = [*whole.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(ids, "<u2").tolist() == expect


def test_perfect_hash_is_minimal_and_tells_foreign_keys():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 1000):
        keys = rng.choice(10**12, size=n, replace=False)
        table = idstore.PerfectHash.build(keys, np.arange(n))
        assert sorted(table.slots.tolist()) == list(range(n))
        assert table.find(keys).tolist() == list(range(n))
        foreign = np.setdiff1d(rng.choice(10**12, size=500) + 10**13, keys)
        assert (table.find(foreign) >= 0).sum() <= 1


@pytest.mark.parametrize("shard_bytes", [1 << 30, 40_000])
def test_id_store_round_trip(spark, shard_bytes):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    folder = idstore.new_folder(spark)
    idstore.write_ids(documents(spark), folder, WORDS, shard_bytes=shard_bytes)
    got = idstore.with_starts(idstore.read_documents(spark, folder)).collect()
    expect = Counter()
    for key, text in ROWS:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        expect[key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["key"], r["n_tokens"], r["ids_crc32"]) for r in got) == expect
    ordered = sorted(got, key=lambda r: r["start"])
    at = 0
    for row in ordered:
        assert row["start"] == at
        at += row["n_tokens"]
    keys = [r["key"] for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    asked = spark.createDataFrame([(2,), (7,), (12345,), (None,), (2,)], "doc_id long")
    found = idstore.lookup(asked, folder).collect()
    assert Counter(r["key"] for r in found) == {2: 2, 7: 1}
    (long,) = [r for r in found if r["key"] == 7]
    assert long["ids"] == [*whole.encode(dict(ROWS)[7], add_special_tokens=False).ids, 2]


def test_id_store_of_an_empty_table(spark):
    folder = idstore.new_folder(spark)
    idstore.write_ids(documents(spark, []), folder, WORDS)
    assert idstore.with_starts(idstore.read_documents(spark, folder)).count() == 0
