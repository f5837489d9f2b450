"""Scores of documents by a recurrent language model, with a unigram base beside it.

1. Word counts over all training documents: counted per task, summed by Spark. They grow with
   the corpus and are the base score as well as the model's shares inside word classes.
2. The ``NUMBERED`` most frequent words are numbered; that list has a fixed bound and goes to
   the tasks. All other words are one class, and a word's share of it needs its count, which a
   join brings; nothing about them is collected.
3. In each round every task trains a copy of the model on its own share of documents, and the
   copies are averaged by tokens, in two levels, in pieces of the parameters. Every training
   document is in one of the ``ROUNDS`` rounds, dealt by key hash.
4. Every whole text is scored, its state carried from window to window.

Tokens are words (what ASCII white space separates, A-Z in lower case), then one end per
document. Null and empty texts are one end. A null key counts as the empty text when keys are
dealt out. Repeated rows are scored one by one and count again. An empty table gives no rows.
Without training documents all words are unseen. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcohort.llm import gru
from fleetcohort.llm.common import crc_mod, keyed_text, pieces, stage

#: Words with a number, how often they must be seen, and how many have vectors of their own.
NUMBERED, LEAST_COUNT, OWN = 1 << 16, 3, 1024
#: Training rounds; each takes its share of the training documents.
ROUNDS = 2
#: Tokens that a task counts, and that it learns from or scores, at a time: with small lots one
#: long document keeps a lane busy when all others are through.
COUNTED, LOT = 1 << 22, 1 << 22
#: Lanes of a training lot, at least and at most, and the windows that a lot should give.
LEAST_LANES, MOST_LANES, WINDOWS = 32, 256, 256
PIECE = 4096


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words one after another, A-Z in lower case, and each text's number of them."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)  # a text that begins or ends with white space
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    return flat.filter(real), np.bincount(owner[real.to_numpy(False)], minlength=len(texts))


def word_counts(rows: DataFrame) -> DataFrame:
    """word and its count ``c`` over all rows' texts, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def counted() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.string()).value_counts()
            return pa.RecordBatch.from_arrays(
                [found.field("values"), found.field("counts")], names=["word", "c"]
            )

        for batch in pieces(batches):
            held.append(split_words(batch.column("text"))[0])
            if sum(map(len, held)) > COUNTED:
                yield counted()
                held.clear()
        if held:
            yield counted()

    counts = rows.select("text").mapInArrow(run, "word string, c long")
    return stage(counts.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


class Vocabulary:
    """Numbered words with the end token (None), by falling count, and the totals."""

    def __init__(self, words: list[tuple[str | None, int]], total: int, distinct: int) -> None:
        words = sorted(words, key=lambda w: -w[1])
        self.words = pa.array([w for w, _ in words], pa.string())
        self.counts = np.array([c for _, c in words], dtype=np.int64)
        self.end = [w for w, _ in words].index(None)
        self.total, self.distinct = total, distinct
        self.rest_tokens = total - int(self.counts.sum())
        self.rest_words = max(0, distinct - len(words))
        self.layout = gru.Layout(self.counts, OWN, float(self.rest_tokens))
        self.log_count = np.log10(self.counts + 1.0)

    def ids(self, words: pa.Array, sizes: np.ndarray) -> list[np.ndarray]:
        """Per text, of ``sizes`` words, the numbers of its words, -1 without, and the end."""
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        ends = np.cumsum(sizes + 1)
        flat = np.full(len(found) + len(sizes), self.end, dtype=np.int32)
        inside = np.ones(len(flat), dtype=bool)
        inside[ends - 1] = False
        flat[inside] = found
        return np.split(flat, ends[:-1])


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    size = counts.agg(F.sum("c").alias("total"), F.count("word").alias("words")).first()
    top = counts.where(F.col("c") >= LEAST_COUNT).orderBy(F.desc("c"), "word").limit(NUMBERED)
    words = [(r["word"], r["c"]) for r in top.collect()]
    return Vocabulary(
        [*words, (None, documents)],
        (size["total"] or 0) + documents,
        size["words"] + (1 if documents else 0),
    )


def _averaged(copies: DataFrame, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mean of the copies' parameters, weighted by tokens: piece, part, weight, own."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        weight = group["weight"].to_numpy(dtype=float)
        own = np.average(np.stack(group["own"].to_numpy()).astype(float), axis=0, weights=weight)
        return pd.DataFrame(
            {"piece": group["piece"].iloc[:1], "part": [0], "weight": [weight.sum()], "own": [own]}
        )

    schema = "piece int, part int, weight double, own array<float>"
    first = copies.groupBy("piece", "part").applyInPandas(run, schema)
    rows = first.groupBy("piece").applyInPandas(run, schema).collect()
    if not rows:
        return like
    rows.sort(key=lambda r: r["piece"])
    return gru.unpack(np.concatenate([np.array(r["own"], dtype=np.float32) for r in rows]), like)


def lanes_for(tokens: int) -> int:
    """Lanes of a training lot: many where it is large, else few, for it to have enough steps."""
    return min(MOST_LANES, max(LEAST_LANES, tokens // (gru.WINDOW * WINDOWS)))


def train(rows: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters after ``ROUNDS`` rounds, which share the training rows out among them."""
    parameters = gru.start(vocabulary.layout)
    for number in range(ROUNDS):
        chosen = rows.where(F.pmod(F.xxhash64(F.lit("lm"), "key"), F.lit(ROUNDS)) == number)

        def run(
            batches: Iterator[pa.RecordBatch], begin: dict[str, np.ndarray] = parameters
        ) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(vocabulary.layout, begin)
            held: list[np.ndarray] = []

            def learn() -> None:
                trainer.learn(held, n_lanes=lanes_for(sum(map(len, held))))
                held.clear()

            for batch in pieces(batches):
                held += vocabulary.ids(*split_words(batch.column("text")))
                if sum(map(len, held)) > LOT:
                    learn()
            if held:
                learn()
            if not trainer.tokens:
                return
            flat = gru.pack(trainer.p)
            lots = [flat[i : i + PIECE] for i in range(0, len(flat), PIECE)]
            n = len(lots)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(n), pa.int32()),
                    pa.array([trainer.tokens % 64] * n, pa.int32()),
                    pa.array([float(trainer.tokens)] * n, pa.float64()),
                    pa.array(lots, pa.list_(pa.float32())),
                ],
                names=["piece", "part", "weight", "own"],
            )

        copies = chosen.select("text").mapInArrow(
            run, "piece int, part int, weight double, own array<float>"
        )
        parameters = _averaged(copies, parameters)
    return parameters


def _unnumbered(split: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Per text the different words without a number, and how often it has each."""
    other = np.flatnonzero(ids < 0)
    coded = split.take(pa.array(other)).dictionary_encode()
    width = max(1, len(coded.dictionary))
    owner = np.repeat(np.arange(len(sizes)), sizes)[other]
    pairs, n = np.unique(owner * width + coded.indices.to_numpy(), return_counts=True)
    offsets = np.searchsorted(pairs // width, np.arange(len(sizes) + 1))
    word = coded.dictionary.take(pa.array(pairs % width))
    columns = [word, pa.array(n, pa.int64())]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["word", "n"])
    )


def _scored(rows: DataFrame, words: Vocabulary, parameters: dict[str, np.ndarray]) -> DataFrame:
    """Per row what needs no other word's count: row, key, held_out, n_tokens, n_head, base and
    model sums of numbered tokens, and the other words with their counts in the text."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = words.counts > 0, [], 0

        def modelled() -> Iterator[pa.RecordBatch]:
            texts = [own for _, ids in held for own in ids]
            model = gru.log_likelihood(parameters, words.layout, texts) / np.log(10.0)
            at = 0
            for kept, ids in held:
                own = pa.array(model[at : at + len(ids)], pa.float64())
                yield kept.append_column("model", own)
                at += len(ids)

        for batch in pieces(batches):
            split, sizes = split_words(batch.column("text"))
            ids = words.ids(split, sizes)
            flat = np.concatenate(ids)
            owner = np.repeat(np.arange(len(ids)), sizes + 1)
            numbered = flat >= 0
            base = np.where(numbered, words.log_count[flat], 0.0)
            kept = batch.select(["row", "key", "held_out"])
            for name, column in (
                ("n_tokens", pa.array(sizes + 1, pa.int64())),
                ("n_head", pa.array(np.bincount(owner[numbered & known[flat]], minlength=len(ids)), pa.int64())),
                ("base", pa.array(np.bincount(owner, weights=base, minlength=len(ids)), pa.float64())),
                ("rest", _unnumbered(split, np.delete(flat, np.cumsum(sizes + 1) - 1), sizes)),
            ):
                kept = kept.append_column(name, column)
            held.append((kept, ids))
            size += len(flat)
            if size > LOT:
                yield from modelled()
                held, size = [], 0
        if held:
            yield from modelled()

    schema = (
        f"row long, key {kind}, held_out boolean, n_tokens long, n_head long, base double,"
        " rest array<struct<word:string,n:bigint>>, model double"
    )
    return stage(rows.mapInArrow(run, schema), "lm-scored")


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = 7, remainder: int = 2
) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(key) modulo ``divisor`` is ``remainder`` are held out of counts and
    training. Both scores are log10 probabilities of the whole text.
    """
    rows = keyed_text(docs, key, text).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("held_out", crc_mod("key", divisor) == remainder)
    training = rows.where(~F.col("held_out"))
    counts = word_counts(training)
    words = vocabulary(counts, training.count())
    parameters = train(training, words)
    scored = _scored(rows, words, parameters)

    # log10(c + 1) of words without a number: their counts come by a join on the word.
    spread = scored.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n")
    found = spread.join(counts, "word")
    rest = found.groupBy("row").agg(
        F.sum("n").alias("rest_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rest_log")
    )
    n_rest = F.aggregate("rest", F.lit(0).cast("long"), lambda a, w: a + w["n"])
    joined = scored.withColumn("n_rest", n_rest).drop("rest").join(rest, "row", "left")
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    base_all = float(np.log10(words.total + words.distinct + 1.0))
    rest_all = float(np.log10(max(words.rest_tokens + words.rest_words, 0) + 1.0))
    return joined.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + rest_log - F.col("n_tokens") * base_all).alias("base_score"),
        (F.col("model") + rest_log - F.col("n_rest") * rest_all).alias("score"),
    )
