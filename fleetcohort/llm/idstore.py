"""Token-id store: binary shards of raw ids with a minimal perfect hash index in each.

A shard is one file. It holds, in ascending key order, one record per document (its ids as
little-endian unsigned integers, two bytes each where the vocabulary allows, else four), and
ends with an index that takes a key to its record in constant time:

    record*   ids, then one line-feed byte that ends the record
    keys      int64 per document, in file order
    offsets   int64 per document: byte offset of its record
    counts    int64 per document: number of ids
    pilots    uint32 per bucket: displacement that makes the hash perfect
    slots     uint32 per distinct key: first document with that key, in file order
    prints    uint32 per distinct key: fingerprint, so that a foreign key is told apart
    tail      eight int64: magic, version, id width, documents, distinct keys, buckets,
              null keys, bytes of the index before the tail; a line-feed byte

Keys are whole numbers. Documents with a null key come first and are outside the hash;
documents that share a key lie side by side and are all found. The files are written and read
by Spark's own text and binary-file sources, so any storage that Spark reaches will do.

Null and empty texts give a record with only the end id. Repeated rows give a record each. An
empty table gives shards without documents or no shards, and no rows when read back. Other
columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetcohort.llm.common import keyed_text, pieces, shared_folder, stage

MAGIC, VERSION, TAIL_WORDS = 0x7364_6977_6B65_7973, 1, 8
#: Bytes of text that one shard stands for.
SHARD_BYTES = 16 << 20
#: Keys per bucket of the hash, on average.
BUCKET_KEYS = 4
CACHE_WORDS = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit finaliser over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + (np.asarray(seed, dtype=np.uint64) + np.uint64(1)) * np.uint64(
            0x9E3779B97F4A7C15
        )
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct whole-number keys: hash, displace, check the print."""

    def __init__(self, pilots: np.ndarray, slots: np.ndarray, prints: np.ndarray) -> None:
        self.pilots, self.slots, self.prints = pilots, slots, prints

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PerfectHash:
        n = len(keys)
        if not n:
            return cls(*(np.zeros(0, dtype=np.uint32) for _ in range(3)))
        n_buckets = -(-n // BUCKET_KEYS)
        bucket = (mix(keys, 0) % np.uint64(n_buckets)).astype(np.int64)
        sizes = np.bincount(bucket, minlength=n_buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(sizes)
        pilots = np.zeros(n_buckets, dtype=np.uint32)
        place = np.full(n, -1, dtype=np.int64)
        taken = np.zeros(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):  # large buckets while there is room
            size = sizes[b]
            if not size:
                break
            members = order[ends[b] - size : ends[b]]
            own, pilot, step = keys[members], 1, 64
            while place[members[0]] < 0:
                tries = np.arange(pilot, pilot + step, dtype=np.uint64)
                spots = (mix(own[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~taken[spots].any(axis=1)
                if size > 1:
                    ordered = np.sort(spots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    first = int(np.argmax(good))
                    pilots[b] = tries[first]
                    place[members] = spots[first]
                    taken[spots[first]] = True
                pilot += step
                step = min(step * 2, max(64, (1 << 16) // int(size)))
        slots, prints = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
        slots[place] = values
        prints[place] = mix(keys, 1 << 33).astype(np.uint32)
        return cls(pilots, slots, prints)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Stored value of each key, -1 where the fingerprint says the key is foreign."""
        n = len(self.slots)
        if not n or not len(keys):
            return np.full(len(keys), -1, dtype=np.int64)
        bucket = (mix(keys, 0) % np.uint64(len(self.pilots))).astype(np.int64)
        spot = (mix(keys, self.pilots[bucket]) % np.uint64(n)).astype(np.int64)
        known = self.prints[spot] == mix(keys, 1 << 33).astype(np.uint32)
        return np.where(known, self.slots[spot].astype(np.int64), -1)


def index_bytes(keys: list[int | None], offsets: list[int], counts: list[int], width: int) -> bytes:
    """The end of a shard file, for documents in file order (null keys first)."""
    nulls = sum(k is None for k in keys)
    numbers = np.array([0 if k is None else k for k in keys], dtype="<i8")
    own = numbers[nulls:]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else own
    table = PerfectHash.build(own[first], first + nulls)
    body = b"".join(
        x.tobytes()
        for x in (
            numbers,
            np.array(offsets, dtype="<i8"),
            np.array(counts, dtype="<i8"),
            table.pilots.astype("<u4"),
            table.slots.astype("<u4"),
            table.prints.astype("<u4"),
        )
    )
    tail = [MAGIC, VERSION, width, len(keys), len(first), len(table.pilots), nulls, len(body)]
    return body + np.array(tail, dtype="<i8").tobytes()


class Shard:
    """Reader of one shard file's bytes."""

    def __init__(self, content: bytes) -> None:
        tail = np.frombuffer(content, "<i8", TAIL_WORDS, len(content) - 1 - 8 * TAIL_WORDS)
        if tail[0] != MAGIC or tail[1] != VERSION:
            raise ValueError("not a token-id shard")
        self.width, n, distinct, buckets, self.nulls, size = (int(x) for x in tail[2:])
        at, parts = len(content) - 1 - 8 * TAIL_WORDS - size, []
        for kind, length in (("<i8", n),) * 3 + (("<u4", buckets),) + (("<u4", distinct),) * 2:
            parts.append(np.frombuffer(content, kind, length, at))
            at += parts[-1].nbytes
        self.content = content
        self.keys, self.offsets, self.counts = parts[:3]
        self.hash = PerfectHash(*parts[3:])

    def ids(self, position: int) -> np.ndarray:
        """Ids of the document at this position of the file."""
        kind = "<u2" if self.width == 2 else "<u4"
        return np.frombuffer(
            self.content, kind, int(self.counts[position]), int(self.offsets[position])
        ).astype("<u4")

    def positions(self, keys: np.ndarray) -> list[list[int]]:
        """Positions of each key's documents: one step to the first, then its neighbours."""
        out = []
        for key, first in zip(keys.tolist(), self.hash.find(keys).tolist(), strict=True):
            found = []
            while 0 <= first < len(self.keys) and self.keys[first] == key:
                found.append(first)
                first += 1
            out.append(found)
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _cache(path: str) -> dict[str, bytes]:
    return {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it shows,
    else one of the letters from U+0100 on, in turn."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


#: From bytes read as Latin-1 to their letters; lower-case ASCII stands for itself.
_LETTERS = str.maketrans(dict(enumerate(_byte_letters())))
#: A run of Latin letters, then signs that are neither letters, digits, white space nor ', < and |.
_LATIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=>?@\[-`{}~]*)")
#: Words that one call hands to the tokenizer.
_LOT = 1000


@lru_cache(maxsize=4)
def _id_bytes(path: str, kind: str) -> list[bytes]:
    """Each id of the vocabulary as bytes."""
    size = _tokenizer(path).get_vocab_size(with_added_tokens=True)
    raw, width = np.arange(size, dtype=kind).tobytes(), np.dtype(kind).itemsize
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _word_ids(path: str, words: list[str], kind: str, cache: dict[str, bytes]) -> None:
    """Put the ids of new words, which hold no blank, into the cache.

    A run of lower-case Latin letters is one token to the tokenizer before its byte pairs, and
    its normaliser leaves it as it is, so it goes straight to the tokenizer's model. A run of
    signs after it is another token. Any other word takes the whole way.
    """
    tokenizer, known = _tokenizer(path), _id_bytes(path, kind)
    tokenize, rest = tokenizer.model.tokenize, []
    # Lower case of bytes is that of A-Z alone.
    plain = " ".join(words).encode("utf-8", "surrogatepass").lower()
    for word, low in zip(words, plain.decode("utf-8", "surrogatepass").split(" "), strict=True):
        found = _LATIN.fullmatch(low)
        # A special token's text is told by its case: words with its first sign stay as is.
        if not found:
            rest.append(word)
            continue
        base, tail = found.groups()
        ids = cache.get(base)
        if ids is None:
            letters = base
            if not base.isascii():
                letters = base.encode("utf-8").decode("latin-1").translate(_LETTERS)
            ids = cache[base] = b"".join([known[t.id] for t in tokenize(letters)])
        if tail:
            if tail not in cache:
                got = tokenizer.encode(tail, add_special_tokens=False).ids
                cache[tail] = np.array(got, dtype=kind).tobytes()
            ids = ids + cache[tail]
        cache[word] = ids
    for i in range(0, len(rest), _LOT):
        part = rest[i : i + _LOT]
        found = tokenizer.encode_batch_fast(part, add_special_tokens=False)
        for word, got in zip(part, found, strict=True):
            cache[word] = np.array(got.ids, dtype=kind).tobytes()


def encode_texts(path: str, texts: list[str], width: int, end_id: int) -> list[bytes]:
    """Ids of each text with the end id, as bytes.

    The tokenizer drops white space and its tokens never cross it, so each distinct word goes
    to the library once. Only blanks, tabs and line ends separate words here; other white
    space stays inside a word and is the library's business.
    """
    cache = _cache(path)
    kind = "<u2" if width == 2 else "<u4"
    if len(cache) > CACHE_WORDS:
        cache.clear()
    end, out = np.array([end_id], dtype=kind).tobytes(), []
    for text in texts:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        new = [w for w in set(words) if w not in cache]
        if new:
            _word_ids(path, new, kind, cache)
        out.append(b"".join([cache[w] for w in words]) + end)
    return out


def id_width(path: str, end_id: int) -> int:
    """Two bytes where every id fits, else four."""
    return 2 if max(_tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode every text and write the shards to ``folder``, keys ascending over the shards."""
    rows = keyed_text(docs, key, text).withColumn("key", F.col("key").cast("long"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    width = id_width(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        offsets: list[int] = []
        counts: list[int] = []
        at = 0
        for batch in pieces(batches):
            out = encode_texts(tokenizer_path, batch.column("text").to_pylist(), width, end_id)
            keys += batch.column("key").to_pylist()
            for record in out:
                offsets.append(at)
                counts.append(len(record) // width)
                at += len(record) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["value"])
        end = index_bytes(keys, offsets, counts, width)
        yield pa.RecordBatch.from_arrays([pa.array([end], type=pa.binary())], names=["value"])

    # The text breaks ties, so that a key with very many rows still spreads.
    dealt = rows.repartitionByRange(shards, "key", F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions("key", F.xxhash64("text"))
    (
        ordered.mapInArrow(run, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("maxRecordsPerFile", 0)
        .option("compression", "none")
        .text(folder)
    )


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per stored document: shard, position, key, n_tokens, ids_crc32, from the shard files.

    Every document is fetched by its key through the shard's hash index; the crc is that of
    the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                shard = Shard(content.as_buffer())
                keys = [None if i < shard.nulls else int(k) for i, k in enumerate(shard.keys)]
                distinct = np.array([k for k, _ in groupby(keys[shard.nulls :])], dtype=np.int64)
                at = [*range(shard.nulls)]
                for found in shard.positions(distinct):
                    at += found
                crcs = [zlib.crc32(shard.ids(i).tobytes()) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([str(path)] * len(at), type=pa.string()),
                        pa.array(at, type=pa.int64()),
                        pa.array([keys[i] for i in at], type=pa.int64()),
                        pa.array([int(shard.counts[i]) for i in at], type=pa.int64()),
                        pa.array(crcs, type=pa.int64()),
                    ],
                    names=["shard", "position", "key", "n_tokens", "ids_crc32"],
                )

    return (
        _files(spark, folder)
        .select("path", "content")
        .mapInArrow(run, "shard string, position long, key long, n_tokens long, ids_crc32 long")
    )


def with_starts(documents: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before, in ascending key order.

    Offsets run inside each shard; one row per shard carries what lies before it.
    """
    documents = stage(documents, "ids-read")
    shards = documents.groupBy("shard").agg(
        F.sum("n_tokens").alias("_total"), F.min("key").alias("_low"), F.max("key").alias("_high")
    )
    before = Window.orderBy(
        F.col("_low").asc_nulls_first(), F.col("_high").asc_nulls_first(), "shard"
    ).rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select(
        "shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    )
    inside = (
        Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        documents.join(bases, "shard")
        .withColumn("start", F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .drop("_base")
    )


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Ids of the documents with the given keys: key, position, ids.

    Each shard's least and greatest key are read from its index; a wanted key goes only to the
    shards whose range holds it, and there takes one step through the hash. Null keys find
    nothing; a repeated key is answered once per stored document.
    """
    spark = keys.sparkSession

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                shard = Shard(content.as_buffer())
                own = shard.keys[shard.nulls :]
                if len(own):
                    yield pa.RecordBatch.from_pylist(
                        [{"path": str(path), "low": int(own[0]), "high": int(own[-1])}]
                    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("position", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for content, wanted in zip(batch.column("content"), batch.column("wanted"), strict=True):
                shard = Shard(content.as_buffer())
                numbers = np.array(sorted(set(wanted.as_py())), dtype=np.int64)
                rows = [
                    {"key": k, "position": i, "ids": shard.ids(i).tolist()}
                    for k, found in zip(numbers.tolist(), shard.positions(numbers), strict=True)
                    for i in found
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = _files(spark, folder).select("path", "content")
    bounds = files.mapInArrow(ranges, "path string, low long, high long")
    wanted = keys.select(F.col(f"`{key}`").cast("long").alias("key")).dropna().distinct()
    asked = (
        wanted.join(bounds, (F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")))
        .groupBy("path")
        .agg(F.collect_list("key").alias("wanted"))
    )
    return files.join(asked, "path").select("content", "wanted").mapInArrow(
        fetch, "key long, position long, ids array<long>"
    )


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
