"""Harmonic packing of token ids into sequences of fixed capacity, without padding.

A worker packs the documents of its partition as they come, independent of all others, so
nothing is shuffled. Whole capacities of a document fill sequences of their own. What is left
of it, a length of (C/(k+1), C/k], belongs to class k and takes its place in that class's open
bin, which is full with exactly k documents; lengths below C/``CLASSES`` share the last class.
The few tokens that a full bin has room for (its gap) are cut from the next document, whose
rest goes on as above; so at most one gap is open at a time and no sequence but the last ones
of a worker is short. When its documents end, a worker lays the contents of its open bins
(``CLASSES`` at most) end to end, fills whole sequences with them, and cuts the remainder into
sequences whose lengths are powers of two, which need no padding either. A worker holds one
batch, its open bins and the ids of one document.

Null and empty texts are documents of the end id alone. Every row is a document of its own,
whether its key or its text is repeated or null. An empty table gives no pieces. Sequence
numbers are unique and ascending within a partition, not gapless over the table. Other columns
are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetcohort.llm.common import keyed_text, pieces

CAPACITY = 1024
#: Harmonic classes; the last one takes all lengths of at most CAPACITY / CLASSES.
CLASSES = 16
#: Sequences that one partition can number.
NUMBERS = 1 << 40
#: Bytes of ids that are handed back at a time.
OUT_BYTES = 4 << 20

#: How byte-level vocabularies cut a text before merging. Fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> dict[str, int]:
    """Byte for each letter that a byte-level vocabulary writes it with: itself where it shows,
    else one of the letters from U+0100 on, in turn."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _is_plain_byte_level(spec: dict) -> bool:
    """Nothing before or after the merges that ranks alone would not reproduce."""
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    vocabulary = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return (
        spec["normalizer"] is None
        and cut.get("type") == "ByteLevel"
        and not cut["add_prefix_space"]
        and cut["use_regex"]
        and model["type"] == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"])
        # A merge's id is its rank.
        and all(vocabulary[a + b] == 256 + i for i, (a, b) in enumerate(merges))
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Function from a text to its ids, equal to the tokenizers library's without special tokens
    added (those that a text spells out are found).

    Where the file is a plain byte-level vocabulary its merges are handed, as ranks, to a
    library that applies them several times faster; any other file is run as it is.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if _is_plain_byte_level(spec):
        import tiktoken

        of = _letters()
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {
            bytes(of[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        encoding = tiktoken.Encoding(
            os.path.basename(path),
            pat_str=BYTE_LEVEL_PATTERN,
            mergeable_ranks=ranks,
            special_tokens=special,
        )
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


class Packer:
    """Places the documents of one worker, given as (tag, number of ids).

    A placed piece is (tag, start, length, sequence, offset), ``start`` counting the document's
    ids before it. Tags are handed back as they came.
    """

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, first: int = 0) -> None:
        self.capacity, self.classes, self.next = capacity, classes, first
        self.bins: dict[int, list[tuple]] = {}  # class -> (tag, start, length) of its open bin
        self.gap: list[tuple] = []  # the full bin that has room left
        self.room = 0

    def _sequence(self, parts: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for tag, start, length in parts:
            yield tag, start, length, self.next, offset
            offset += length
        self.next += 1

    def add(self, tag, n: int) -> Iterator[tuple]:
        """The pieces that are placed for good now that this document is in."""
        start = 0
        if self.gap:
            start = min(self.room, n)
            self.gap.append((tag, 0, start))
            self.room -= start
            if not self.room:
                yield from self._sequence(self.gap)
                self.gap = []
        while n - start >= self.capacity:
            yield from self._sequence([(tag, start, self.capacity)])
            start += self.capacity
        if start == n:
            return
        k = min(self.classes, self.capacity // (n - start))
        own = self.bins.setdefault(k, [])
        own.append((tag, start, n - start))
        if len(own) == k:
            del self.bins[k]
            self.gap, self.room = own, self.capacity - sum(p[2] for p in own)
            if not self.room:
                yield from self._sequence(self.gap)
                self.gap = []

    def end(self) -> Iterator[tuple]:
        """The contents of all open bins, cut into full sequences and powers of two."""
        left = [p for own in (self.gap, *(self.bins[k] for k in sorted(self.bins))) for p in own]
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        at = iter(left)
        tag, start, length = next(at, (None, 0, 0))
        for size in sizes:
            parts = []
            while size:
                if not length:
                    tag, start, length = next(at)
                cut = min(size, length)
                parts.append((tag, start, cut))
                start, length, size = start + cut, length - cut, size - cut
            yield from self._sequence(parts)
        self.bins, self.gap, self.room = {}, [], 0


_SCHEMA = pa.schema(
    [
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    capacity: int = CAPACITY,
    classes: int = CLASSES,
) -> DataFrame:
    """Per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. Every id of a document, its end id included, lies in one piece."""
    rows = keyed_text(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4")
        packer = Packer(capacity, classes, TaskContext.get().partitionId() * NUMBERS)
        key_type, out, size = None, [], 0

        def flush() -> pa.RecordBatch:
            keys, *columns = zip(*out, strict=True)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, _SCHEMA, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, type=key_type), *arrays], ["key", *_SCHEMA.names])

        def rows_of(placed: Iterator[tuple]) -> int:
            added = 0
            for (own, ids), start, length, sequence, offset in placed:
                part = ids[4 * start : 4 * (start + length)]
                out.append((own, start, length, part, len(ids) // 4, sequence, offset))
                added += len(part)
            return added

        for batch in pieces(batches):
            key_type = batch.schema.field("key").type
            keys = batch.column("key").to_pylist()
            for own, value in zip(keys, batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate((encode(value).astype("<u4", copy=False), end)).tobytes()
                size += rows_of(packer.add((own, ids), len(ids) // 4))
                if size > OUT_BYTES:
                    yield flush()
                    out, size = [], 0
        rows_of(packer.end())
        if out:
            yield flush()

    return rows.mapInArrow(
        run,
        f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    ).withColumnRenamed("key", key)
