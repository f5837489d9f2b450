"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of continuation pieces and one of word-start pieces. Every node has a
failure link and the number of pieces popped on the way there, so a word is walked once,
character by character, and only counts are kept: no piece is ever built. All new words of a
batch walk together, one character column at a time.

A word that the vocabulary cannot cover counts as one unknown piece. Null and empty texts have
zero words and pieces. Null keys and repeated rows stay, one row each. An empty table gives no
rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetcohort.llm.common import keyed_text, pieces

#: White space between words; other characters belong to words.
SEPARATORS = " \t\n\v\f\r"
CACHE_WORDS = 500_000
_DEAD = -1


class CountAutomaton:
    """Trie with failure links and popped-piece counts over start and continuation pieces."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]) -> None:
        # Node 0: a word begins. Node 1: something has been popped, a continuation begins.
        children: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, vocabulary in ((0, starts), (1, continuations)):
            for piece in vocabulary:
                node = root
                for c in piece:
                    if c not in children[node]:
                        children[node][c] = len(children)
                        children.append({})
                        final.append(False)
                    node = children[node][c]
                if node > 1:
                    final[node] = True
        link = [_DEAD] * len(children)
        popped = [0] * len(children)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in children[node].items():
                    below.append(child)
                    if final[child]:
                        link[child], popped[child] = 1, 1
                        continue
                    at, count = link[node], popped[node]
                    while at != _DEAD and c not in children[at]:
                        count += popped[at]
                        at = link[at]
                    if at != _DEAD:
                        link[child], popped[child] = children[at][c], count
            level = below
        self.link, self.popped = np.array(link), np.array(popped)
        edges = sorted(
            ((node << 21) | ord(c), child)
            for node, kids in enumerate(children)
            for c, child in kids.items()
        )
        self.edge = np.array([e for e, _ in edges] or [-1], dtype=np.int64)
        self.to = np.array([t for _, t in edges] or [_DEAD], dtype=np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        wanted = (node << 21) | char
        at = np.minimum(np.searchsorted(self.edge, wanted), len(self.edge) - 1)
        return np.where((self.edge[at] == wanted) & (node >= 0), self.to[at], _DEAD)

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each (non-empty) word; -1 where the vocabulary cannot cover it."""
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        order = np.argsort(-lengths, kind="stable")  # at each column the walking words lead
        lengths = lengths[order]
        flat = np.frombuffer(
            "".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), dtype="<u4"
        ).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        node, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for column in range(int(lengths[0])):
            active = int(np.searchsorted(-lengths, -column, side="left"))
            char = flat[first[:active] + column]
            here = node[:active]
            after = self._step(here, char)
            stuck = np.flatnonzero((after == _DEAD) & (here != _DEAD))
            while len(stuck):
                total[stuck] += self.popped[here[stuck]]
                here[stuck] = self.link[here[stuck]]
                stuck = stuck[here[stuck] != _DEAD]
                after[stuck] = self._step(here[stuck], char[stuck])
                stuck = stuck[after[stuck] == _DEAD]
            node[:active] = after
        open_ = np.flatnonzero((node != 1) & (node != _DEAD))
        while len(open_):
            total[open_] += self.popped[node[open_]]
            node[open_] = self.link[node[open_]]
            open_ = open_[(node[open_] != 1) & (node[open_] != _DEAD)]
        total[node == _DEAD] = -1
        out = np.empty(n, dtype=np.int64)
        out[order] = total
        return out


def vocabulary(model_path: str, mark: str = "▁") -> tuple[list[str], list[str]]:
    """Word-start pieces (their mark cut off) and continuation pieces of a piece model file.

    A start piece that is the mark alone stands for no character and is left out.
    """
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=model_path)
    starts, rest = [], []
    for i in range(reader.get_piece_size()):
        if reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i):
            continue
        piece = reader.id_to_piece(i)
        if piece.startswith(mark):
            if len(piece) > 1 and mark not in piece[1:]:
                starts.append(piece[1:])
        else:
            rest.append(piece)
    return starts, rest


@lru_cache(maxsize=2)
def load(model_path: str) -> CountAutomaton:
    return CountAutomaton(*vocabulary(model_path))


@lru_cache(maxsize=2)
def _cache(model_path: str) -> dict[str, int]:
    return {}


_SPLIT = str.maketrans(dict.fromkeys(SEPARATORS, " "))


def split_words(text: str) -> list[str]:
    return [w for w in text.translate(_SPLIT).split(" ") if w]


def token_counts(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_pieces`` (an unknown word is one), ``n_unknown``."""
    rows = keyed_text(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = load(model_path), _cache(model_path)
        for batch in pieces(batches):
            per_text = [split_words(t) for t in batch.column("text").to_pylist()]
            if len(cache) > CACHE_WORDS:
                cache.clear()
            new = list({w for words in per_text for w in words if w not in cache})
            cache.update(zip(new, automaton.counts(new).tolist(), strict=True))
            n, total, unknown = [], [], []
            for words in per_text:
                found = [cache[w] for w in words]
                missed = found.count(-1)
                n.append(len(words))
                total.append(sum(found) + 2 * missed)  # -1 becomes 1
                unknown.append(missed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(x, type=pa.int64()) for x in (n, total, unknown))],
                names=["key", "n_words", "n_pieces", "n_unknown"],
            )

    out = rows.mapInArrow(run, f"key {kind}, n_words long, n_pieces long, n_unknown long")
    return out.withColumnRenamed("key", key)
