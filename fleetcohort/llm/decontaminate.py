"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

Every document is cut into overlapping passages that cover its whole text. Each passage is a
query against an inverted index of the benchmark items, cut into blocks of items. Block-max
WAND in batches: a passage whose terms' bounds do not add up to the threshold is done; a block
whose own term maxima do not is skipped; only what is left is scored, exactly. So all items
that reach the threshold are retrieved, and no others. A retrieved item counts as leaked if
enough of its question's and of its answer's word n-grams stand in the document.

Scores are BM25 with the item as the document, as a share of the score that the item reaches
when a passage holds all of its words, so the threshold does not depend on an item's length.

The index is built from the benchmark alone and goes to the tasks. Its size is checked: a
benchmark of more than ``PART_ITEMS`` items or ``PART_BYTES`` bytes is cut by a hash of the
words into parts below that, and the documents are searched once per part. Statistics (items,
mean and greatest length, in how many items a term stands) are those of the whole benchmark,
and items are made distinct by their words before the cut, so the parts change no result.

Words are what ASCII white space separates, A-Z in lower case, outer punctuation stripped.
Null and empty texts, and items without words, match nothing. Items with the same words are
reported once, by their least item id; an id is null only if all of them have none. Null keys and repeated rows stay, one row each. Empty tables:
without documents no rows, without items no leaks. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcohort.llm.common import pieces, small_batches, stage

K1, B = 1.2, 0.75
#: Least words of a passage. It is at least twice the longest item, and the next one starts
#: half a passage later, so every stretch as long as an item lies whole in some passage.
PASSAGE = 128
#: Share of an item's full score that a passage must reach.
SHARE = 0.5
#: Word n-gram length of the overlap check, and the shares of question and answer needed.
GRAM, QUESTION, ANSWER = 5, 0.6, 0.5
#: Items of one block, with a score bound of its own for each term.
BLOCK = 4
#: Items and bytes of one part of the benchmark, about; an index then has some ten megabytes.
PART_ITEMS, PART_BYTES = 2000, 4 << 20

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = string.punctuation


def _raw_words(text: str) -> list[str]:
    """Words with their punctuation; A-Z in lower case, as bytes know no other case."""
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in _raw_words(text)) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item without its last sentence, and of that; one sentence is a question."""
    ends = [m.end() for m in re.finditer(r"[.?!:]\s+|\n+", text.rstrip())]
    if not ends:
        return words_of(text), []
    question, answer = words_of(text[: ends[-1]]), words_of(text[ends[-1] :])
    return (question, answer) if question else (answer, [])


class _Terms(dict):
    """Term number of a raw word, -1 if no item has it; emptied when it has grown large."""

    def __init__(self, numbers: dict[str, int]) -> None:
        self.numbers = numbers

    def __missing__(self, raw: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[raw] = self.numbers.get(raw.strip(_EDGE), -1)
        return found


@dataclass
class Statistics:
    """Of a whole benchmark: distinct items, their words, most words of one, items by term."""

    items: int
    words: int
    longest: int
    frequency: dict[str, int]

    @classmethod
    def of(cls, texts: list[tuple[str, ...]]) -> Statistics:
        frequency = Counter(t for words in texts for t in set(words))
        return cls(len(texts), sum(map(len, texts)), max(map(len, texts), default=0), frequency)


def _id_order(item_id: int | None) -> tuple[bool, int]:
    """Ids ascending, a null one last."""
    return item_id is None, item_id or 0


@dataclass
class Item:
    item_id: int | None
    question: list[str]
    answer: list[str]
    #: By term number: what it adds, as a share of the item's full score.
    weights: dict[int, float]


class Index:
    """Items in blocks, with each term's largest weight overall and in each block.

    ``whole`` are the statistics of the benchmark that ``rows`` are a part of; without, ``rows``
    are all of it.
    """

    def __init__(
        self, rows: list[tuple[int | None, str]], whole: Statistics | None = None
    ) -> None:
        texts: dict[tuple[str, ...], tuple[int | None, str]] = {}
        for item_id, text in sorted(rows, key=lambda r: (*_id_order(r[0]), r[1])):
            words = words_of(text)
            if words:
                texts.setdefault(tuple(words), (item_id, text))
        whole = whole or Statistics.of(list(texts))
        mean = whole.words / max(1, whole.items)
        numbers = {t: n for n, t in enumerate(dict.fromkeys(t for own in texts for t in own))}
        self.terms = _Terms(numbers)
        self.items: list[Item] = []
        self.passage = max(PASSAGE, 2 * whole.longest)
        # Items of like length lie together, so that a block's maxima are near its weights.
        for words, (item_id, text) in sorted(texts.items(), key=lambda x: len(x[0])):
            norm = K1 * (1 - B + B * len(words) / mean)
            weights = {}
            for term, count in Counter(words).items():
                seen = whole.frequency[term]
                idf = math.log(1 + (whole.items - seen + 0.5) / (seen + 0.5))
                weights[numbers[term]] = idf * count * (K1 + 1) / (count + norm)
            full = sum(weights.values())
            weights = {t: w / full for t, w in weights.items()}
            self.items.append(Item(item_id, *question_and_answer(text), weights))
        blocks = -(-len(self.items) // BLOCK)
        self.block_most = np.zeros((len(numbers), max(1, blocks)), dtype=np.float32)
        for n, item in enumerate(self.items):
            for term, weight in item.weights.items():
                old = self.block_most[term, n // BLOCK]
                self.block_most[term, n // BLOCK] = max(old, weight)
        self.most = self.block_most.max(axis=1) if numbers else np.zeros(0, np.float32)

    def retrieve(
        self, passage: np.ndarray, term: np.ndarray, share: float
    ) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all scores of at least ``share``.

        ``passage`` and ``term`` list the distinct known terms of each passage, in order.
        """
        found = []
        if not len(term):
            return found
        starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        ends = np.append(starts[1:], len(term))
        slack = share - 1e-4  # the bounds are in single precision
        open_ = np.flatnonzero(np.add.reduceat(self.most[term], starts) >= slack)
        for lot in np.array_split(open_, -(-len(open_) // 4096) or 1):
            if not len(lot):
                continue
            sizes = ends[lot] - starts[lot]
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            at = np.repeat(starts[lot] - first, sizes) + np.arange(sizes.sum())
            bounds = np.add.reduceat(self.block_most[term[at]], first, axis=0)
            for n, block in zip(*np.nonzero(bounds >= slack), strict=True):
                own = set(term[starts[lot[n]] : ends[lot[n]]].tolist())
                for i in range(block * BLOCK, min((block + 1) * BLOCK, len(self.items))):
                    score = sum(w for t, w in self.items[i].weights.items() if t in own)
                    if score >= share - 1e-9:
                        found.append((int(passage[starts[lot[n]]]), i, score))
        return found


def _share_found(own: list[str], grams: set[tuple[str, ...]], present: set[str]) -> float:
    """Share of the words' n-grams among the document's; of the words, if they are fewer."""
    if len(own) < GRAM:
        return sum(w in present for w in own) / len(own) if own else 1.0
    mine = [tuple(own[i : i + GRAM]) for i in range(len(own) - GRAM + 1)]
    return sum(g in grams for g in mine) / len(mine)


def search(
    index: Index, texts: list[str], share: float = SHARE
) -> list[list[tuple[int, float, float, float]]]:
    """Leaked items of each text: item id, best BM25 share, question and answer overlap."""
    half, terms = index.passage // 2, index.terms
    numbers, counts = [], []
    for text in texts:
        raw = _raw_words(text)
        counts.append(len(raw))
        numbers += [terms[w] for w in raw]
    term = np.array(numbers, dtype=np.int64)
    count = np.array(counts, dtype=np.int64)
    # Half passages are numbered through all texts; a passage is two neighbours of one text.
    halves = -(-count // half)
    base = np.concatenate(([0], np.cumsum(halves)))
    text_of = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(term)) - np.repeat(np.cumsum(count) - count, count)
    known = np.flatnonzero(term >= 0)
    at = base[text_of[known]] + inside[known] // half
    earlier = inside[known] >= half
    width = max(1, len(index.most))
    keys = np.unique(np.concatenate((at, at[earlier] - 1)) * width + np.concatenate(
        (term[known], term[known][earlier])
    ))
    best: dict[int, dict[int, float]] = {}
    for passage, item, score in index.retrieve(keys // width, keys % width, share):
        own = best.setdefault(int(np.searchsorted(base, passage, side="right")) - 1, {})
        own[item] = max(own.get(item, 0.0), score)
    out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
    for n, scores in best.items():
        words = words_of(texts[n])
        grams = set(zip(*(words[i:] for i in range(GRAM)), strict=False))
        present = set(words)
        for i, score in sorted(scores.items()):
            item = index.items[i]
            question = _share_found(item.question, grams, present)
            answer = _share_found(item.answer, grams, present)
            if question >= QUESTION and answer >= ANSWER:
                out[n].append((item.item_id, score, question, answer))
        out[n].sort(key=lambda x: _id_order(x[0]))
    return out


def _distinct_items(items: DataFrame, item_key: str, text: str) -> DataFrame:
    """words, item and text of the items that differ in words, as a written table."""
    rows = items.select(
        F.col(f"`{item_key}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text")
    ).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            yield batch.append_column("words", pa.array(words, pa.list_(pa.string())))

    split = rows.mapInArrow(run, "item long, text string, words array<string>")
    first = F.min(F.struct(F.col("item").isNull().alias("none"), "item", "text")).alias("first")
    distinct = split.where(F.size("words") > 0).groupBy("words").agg(first)
    return stage(distinct.select("words", "first.item", "first.text"), "leaks-items")


def _indexes(items: DataFrame, item_key: str, text: str) -> list[Index]:
    """One index per part of the items; the driver gathers one bounded part at a time."""
    rows = _distinct_items(items, item_key, text)
    n_words = F.size("words")
    size = rows.agg(
        F.count("words").alias("n"), F.sum(F.octet_length("text")).alias("bytes"),
        F.sum(n_words).alias("words"), F.max(n_words).alias("longest"),
    ).first()
    if not size["n"]:
        return [Index([])]
    parts = max(-(-size["n"] // PART_ITEMS), -(-size["bytes"] // PART_BYTES))

    def part_of(words: Column) -> Column:
        return F.pmod(F.xxhash64(words), F.lit(parts)).cast("int")

    rows = rows.withColumn("part", part_of(F.col("words")))
    terms = rows.select("part", F.explode(F.array_distinct("words")).alias("term"))
    counts = terms.groupBy("term").agg(F.count("part").alias("n"))
    known = terms.distinct().join(counts, "term") if parts > 1 else counts.withColumn("part", F.lit(0))
    known = stage(known.select("part", "term", "n"), "leaks-terms")
    found = []
    for part in range(parts):
        own = rows.where(F.col("part") == part).select("item", "text").collect()
        frequency = {r["term"]: r["n"] for r in known.where(F.col("part") == part).collect()}
        whole = Statistics(size["n"], size["words"], size["longest"], frequency)
        found.append(Index([(r["item"], r["text"]) for r in own], whole))
    return found


_FOUND = pa.list_(
    pa.struct(
        [
            ("item_id", pa.int64()),
            ("share", pa.float64()),
            ("question", pa.float64()),
            ("answer", pa.float64()),
        ]
    )
)
_FOUND_DDL = "array<struct<item_id:bigint,share:double,question:double,answer:double>>"


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
    found: str = "leaks",
) -> DataFrame:
    """``docs`` with one more column ``found``: the items that stand in the row's text, each
    with its best share of the full BM25 score and its question and answer overlap."""
    small_batches(docs.sparkSession)
    for index in _indexes(items, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text):
                rows = search(index, [t or "" for t in batch.column(text).to_pylist()], share)
                names = ("item_id", "share", "question", "answer")
                out = pa.array([[dict(zip(names, r, strict=True)) for r in x] for x in rows], _FOUND)
                if found in batch.schema.names:  # what an earlier part of the items gave
                    at = batch.schema.names.index(found)
                    old = batch.column(at).to_pylist()
                    both = [
                        sorted((a or []) + (b or []), key=lambda x: _id_order(x["item_id"]))
                        for a, b in zip(old, out.to_pylist(), strict=True)
                    ]
                    yield batch.set_column(at, pa.field(found, _FOUND), pa.array(both, _FOUND))
                else:
                    yield batch.append_column(pa.field(found, _FOUND), out)

        if found in docs.columns:
            docs = docs.mapInArrow(run, docs.schema)
        else:
            fields = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields
            )
            docs = docs.mapInArrow(run, f"{fields}, `{found}` {_FOUND_DDL}")
    return docs
