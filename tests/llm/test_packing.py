"""Harmonic packing: every id in one piece, sequences without gaps, no padding."""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from fleetcohort.llm import packing, queries
from fleetcohort.llm.common import tokenizer_file
from tests.llm.helpers import LONG, documents

BYTES = tokenizer_file("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def library_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def sequences_of(rows) -> dict[int, int]:
    """Length of each sequence; its pieces have to follow each other without a gap."""
    parts = defaultdict(list)
    for r in rows:
        parts[r["sequence_id"]].append((r["offset"], r["length"]))
    out = {}
    for number, found in parts.items():
        end = 0
        for offset, length in sorted(found):
            assert offset == end and length > 0
            end += length
        out[number] = end
    return out


def assert_unpadded(lengths, capacity=1024):
    assert all(n <= capacity and n & (n - 1) == 0 for n in lengths)


def test_awkward_rows(spark):
    df = documents(spark)
    rows = packing.pack(df, BYTES).collect()
    assert_unpadded(sequences_of(rows).values())
    wanted = sorted(
        (str(r["doc_id"]), np.array(library_ids(r["text"]), dtype="<u4").tobytes()) for r in df.collect()
    )
    # Rows that share a key are told apart by their pieces' places: walk them in order.
    found = []
    by_key = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_key[str(r["doc_id"])].append(r)
    for key, own in by_key.items():
        texts = [b for k, b in wanted if k == key]
        for text in sorted(set(texts)):
            n, times = len(text) // 4, texts.count(text)
            mine = [r for r in own if r["doc_tokens"] == n]
            covered = np.zeros(n, dtype=int)
            for r in mine:
                part = text[4 * r["start"] : 4 * (r["start"] + r["length"])]
                if part == bytes(r["ids"]):
                    covered[r["start"] : r["start"] + r["length"]] += 1
            assert (covered == times).all(), key
            found += [(key, text)] * times
    assert sorted(found) == wanted


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), BYTES).count() == 0


@pytest.mark.parametrize("capacity,classes", [(16, 4), (64, 16), (8, 8), (1024, 16)])
def test_packer_places_everything_once(capacity, classes):
    rng = np.random.default_rng(capacity)
    for top in (3, capacity // 2, capacity, 5 * capacity):
        sizes = rng.integers(1, top + 1, 500).tolist()
        packer = packing.Packer(capacity, classes, first=7)
        placed = [p for tag, n in enumerate(sizes) for p in packer.add(tag, n)]
        assert sum(map(len, packer.bins.values())) + len(packer.gap) <= classes * classes + capacity
        placed += packer.end()
        at = defaultdict(int)
        for tag, start, length, _, _ in sorted(placed):
            assert start == at[tag] and length > 0
            at[tag] += length
        assert [at[i] for i in range(len(sizes))] == sizes
        rows = [{"sequence_id": p[3], "offset": p[4], "length": p[2]} for p in placed]
        lengths = sequences_of(rows)
        assert_unpadded(lengths.values(), capacity)
        assert min(lengths) == 7 and len(lengths) == max(lengths) - 6
        # At most one short sequence of each length.
        short = [n for n in lengths.values() if n < capacity]
        assert len(short) == len(set(short))


def test_a_class_holds_a_fixed_number_of_documents():
    packer = packing.Packer(100, 4)
    assert not list(packer.add("a", 40)) and not list(packer.add("b", 45))
    # Two lengths of (100/3, 100/2] fill a bin; its room of 15 is cut from the next document.
    assert list(packer.add("c", 20)) == [("a", 0, 40, 0, 0), ("b", 0, 45, 0, 40), ("c", 0, 15, 0, 85)]
    assert packer.bins == {4: [("c", 15, 5)]}


def test_ids_equal_the_library_for_odd_texts():
    encode = packing.encoder(BYTES)
    points = [*range(0x0, 0x3000), *range(0xA000, 0xB000), *range(0x1F000, 0x1F800), *range(0x10800, 0x10900)]
    texts = [
        "".join(f"a{chr(c)}1 {chr(c)} b{chr(c)}{chr(c)}  {chr(c)}.," for c in points[i : i + 200])
        for i in range(0, len(points), 200)
    ]
    texts += [LONG, "x" * 50_000, " " * 9_999 + "\n\n a", "I'll we've 'S", "<|endoftext|> a <|endoftext|>", ""]
    for text in texts:
        assert [*encode(text).tolist(), 0] == library_ids(text)


def test_other_vocabularies_go_through_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    text = "Lower CASE words, and <|endoftext|>"
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_query_over_the_test_table(spark, small):
    rows = queries.op12_packing(spark, small).collect()
    lengths = sequences_of(rows)
    assert_unpadded(lengths.values())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for key, own in pieces.items():
        ids, at = np.array(library_ids(texts[key]), dtype="<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
