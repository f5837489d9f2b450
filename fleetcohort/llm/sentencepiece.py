"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

All words of a batch that are new to the task lie in one flat array of symbols. A round looks
up the rank of every adjacent pair, takes the lowest rank of each word (a segmented minimum),
merges its occurrences from the left at the same time, and compacts the array; words without
a mergeable pair leave it. Ids equal those of the sentencepiece library: merging several
occurrences at once is exact unless a piece made by the merge could take part in a pair of a
better rank; for such pieces (known from the vocabulary) only the leftmost occurrence merges.

Pieces hold white space only at their start, so a text falls into independent words.

Null and empty texts give no ids but the end id. Null keys and repeated rows stay, one row
each. An empty table gives no rows. Other columns of the input are not read. The memory of a
task is a chunk of text, or one document, and a bounded word cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetcohort.llm.common import keyed_text, pieces

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_NO_PAIR = np.int64(1 << 40)

#: Words whose ids a Python worker remembers; the cache is emptied when it is full.
CACHE_WORDS = 300_000


class PieceModel:
    """Vocabulary and merge table of a byte-pair model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = reader.get_piece_size()
        self.pieces = [reader.id_to_piece(i) for i in range(self.size)]
        self.bytes = {}
        normal = []
        for i in range(self.size):
            if reader.is_byte(i):
                self.bytes[int(self.pieces[i][1:-1], 16)] = i
            elif not (reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)):
                normal.append(i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(self.size) if reader.is_control(i)}
        self.unknown = {i for i in range(self.size) if reader.is_unknown(i)}
        special = self.byte_of.keys() | self.silent | self.unknown
        self.plain = {
            i: p.replace(SPACE, " ") for i, p in enumerate(self.pieces) if i not in special
        }
        scores = np.array([reader.get_score(i) for i in normal])
        order = [normal[i] for i in np.argsort(-scores, kind="stable")]
        ids = {self.pieces[i]: i for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece holds white space after its start; words would depend")
        # A symbol is a piece id, or size + code point for a character outside the vocabulary.
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

        def code(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else ids.get(part)

        rank_of = {i: r for r, i in enumerate(order)}
        keys, values, lone = [], [], set()
        for r, i in enumerate(order):
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                left, right = code(piece[:cut]), code(piece[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * (self.size + 0x110000) + right)
                values.append(r)
                # A part that ranks below the whole: merging the part makes a better pair.
                lone.update(p for p in (left, right) if rank_of.get(p, -1) > r)
        at = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[at]
        self.ranks = np.array(values, dtype=np.int64)[at]
        self.id_of_rank = np.array(order, dtype=np.int64)
        self.one_at_a_time = np.zeros(len(order), dtype=bool)
        for i in lone:
            self.one_at_a_time[rank_of[i]] = True

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * np.int64(self.size + 0x110000) + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NO_PAIR)

    def _ranks_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these positions."""
        ranks = np.full(len(at), _NO_PAIR)
        inside = np.flatnonzero(at < len(symbols) - 1)
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        left = at[inside]
        ranks[inside] = self.pair_ranks(symbols[left], symbols[left + 1])
        return ranks

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; a word starts with its white-space marks."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.symbol[points]
        word = np.repeat(np.arange(len(words)), lengths)
        ranks = self._ranks_at(symbols, word, np.arange(len(symbols)))
        done_symbols, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(least, sizes)
            live = best < _NO_PAIR
            if not live.all():
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
                symbols, word, ranks, best = symbols[live], word[live], ranks[live], best[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == best)
            # Overlapping occurrences: every second one of a run, from its left end.
            fresh = np.concatenate(([True], np.diff(hit) != 1))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            single = self.one_at_a_time[ranks[hit]]
            if single.any():
                first = np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))
                hit = hit[first | ~single]
            symbols[hit] = self.id_of_rank[ranks[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            merged = hit - np.arange(len(hit))  # as many symbols before each have gone
            ranks[merged] = self._ranks_at(symbols, word, merged)
            before = merged[merged > 0] - 1
            ranks[before] = self._ranks_at(symbols, word, before)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        at = np.argsort(word, kind="stable")
        symbols, word = symbols[at], word[at]
        counts = np.bincount(word, minlength=len(words))
        parts = np.split(symbols, np.cumsum(counts)[:-1])
        for n in np.unique(word[symbols >= self.size]):  # characters outside the vocabulary
            parts[n] = np.array(
                [
                    i
                    for s in parts[n]
                    for i in (
                        [s]
                        if s < self.size
                        else [self.bytes[b] for b in chr(s - self.size).encode("utf-8")]
                    )
                ],
                dtype=np.int64,
            )
        return parts

    def words(self, text: str) -> list[str]:
        """The independent words of a text, white space as marks, with the added first mark."""
        return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without an end id."""
        return [int(i) for part in self.encode_words(self.words(text)) for i in part]

    def raw(self, ids: Iterable[int]) -> str:
        """Pieces of the ids joined, bytes decoded, white space still as it stands in pieces."""
        ids = list(ids)
        if all(map(self.plain.__contains__, ids)):
            return "".join([self.plain[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:  # any other id ends a run of bytes, a silent one too
                out.append(_from_bytes(bytes(run)))
                run.clear()
            if i in self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.plain[i])
        out.append(_from_bytes(bytes(run)))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; the added first white space goes, control ids are silent."""
        ids = list(ids)
        first = next((i for i in ids if i not in self.silent), None)
        text = self.raw(ids)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


def _from_bytes(run: bytes) -> str:
    """UTF-8 of the bytes; each byte that is part of no character gives one U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for width in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + width].decode("utf-8"))
                    i += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=2)
def _word_cache(path: str) -> dict[str, tuple[bytes, str]]:
    return {}


def _encode_batch(model: PieceModel, cache: dict, texts: list[str], end_id: int | None):
    per_text = [model.words(t) for t in texts]
    if len(cache) > CACHE_WORDS:
        cache.clear()
    new = list({w for words in per_text for w in words if w not in cache})
    for word, ids in zip(new, model.encode_words(new), strict=True):
        cache[word] = (ids.astype("<i4").tobytes(), model.raw(ids.tolist()))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    payloads, decoded = [], []
    for words in per_text:
        found = [cache[w] for w in words]
        payloads.append(b"".join([f[0] for f in found]) + end)
        # Word boundaries are piece boundaries, and no run of bytes crosses a mark.
        decoded.append("".join([f[1] for f in found])[1:])
    return payloads, decoded


def encode_decode(
    docs: DataFrame,
    model_path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = 2,
) -> DataFrame:
    """Per row: ``key``, ``ids`` of the whole text with an end id, and ``decoded``, the text
    that the ids give back."""
    rows = keyed_text(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(model_path), _word_cache(model_path)
        for batch in pieces(batches):
            payloads, decoded = _encode_batch(model, cache, batch.column("text").to_pylist(), end_id)
            counts = np.fromiter((len(p) // 4 for p in payloads), dtype=np.int64)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            flat = np.frombuffer(b"".join(payloads), dtype="<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), ids, pa.array(decoded, type=pa.string())],
                names=["key", "ids", "decoded"],
            )

    out = rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)
