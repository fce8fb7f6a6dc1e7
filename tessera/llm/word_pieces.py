"""Token counts by linear longest match over a trie with failure links (Song et al., 2021).

The vocabulary's strings form a trie over 512 symbols: the 256 bytes, and the 256 bytes that
end a word. Every node holds a failure link and the number of pieces popped on taking it, so
a word's greedy longest-match-first pieces are counted in one pass and none is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import materialise, text_groups
from tessera.llm.tokenize import byte_level_map, vocabulary_path

#: Words that a worker remembers; it starts anew beyond this.
CACHE_WORDS = 800_000


def load_pieces(path: str) -> set[tuple[int, ...]]:
    """The vocabulary as symbol strings; a piece that ends a word has 256 added to its last byte."""
    from tokenizers import Tokenizer

    byte = {c: b for b, c in byte_level_map().items() if c != " "} | {"Ġ": 32}
    pieces = set()
    for token in Tokenizer.from_file(path).get_vocab(with_added_tokens=False):
        last = token.endswith("</w>") and len(token) > 4
        symbols = [byte[c] for c in (token[:-4] if last else token)]
        if last:
            symbols[-1] += 256
        pieces.add(tuple(symbols))
    return pieces | {(s,) for s in range(512)}


class PieceCounter:
    """The automaton: children, failure link and popped count of each node."""

    def __init__(self, pieces: set[tuple[int, ...]]):
        self.child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for s in piece:
                if s not in self.child[at]:
                    self.child[at][s] = len(self.child)
                    self.child.append({})
                    final.append(False)
                at = self.child[at][s]
            final[at] = True
        self.fail = [0] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in self.child[u].items():
                queue.append(v)
                if final[v]:
                    self.popped[v] = 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while s not in self.child[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                self.fail[v], self.popped[v] = self.child[z][s], n

    def count(self, word: bytes) -> int:
        """Pieces of one word (its bytes), which is not empty."""
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for s in (*word[:-1], word[-1] + 256):
            while s not in child[at]:
                n += popped[at]
                at = fail[at]
            at = child[at][s]
        while at:
            n += popped[at]
            at = fail[at]
        return n


class _Worker:
    def __init__(self, path: str):
        self.counter, self.known = PieceCounter(load_pieces(path)), {}

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and words of each text; words are what ASCII white space parts, in lower-case ASCII."""
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, count = self.known, self.counter.count
        n = np.zeros(len(words), dtype=np.int64)
        for k, w in enumerate(words):
            if (c := known.get(w)) is None:
                c = known[w] = count(w) if w else 0
            n[k] = c
        full = np.array([bool(w) for w in words], dtype=np.int64)
        place = coded.indices.to_numpy() if len(coded) else np.zeros(0, dtype=np.int64)
        sums = [np.append(0, np.cumsum(x[place])) for x in (n, full)]
        return tuple(s[bounds[1:]] - s[bounds[:-1]] for s in sums)


_WORKERS: dict[str, _Worker] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKERS:
            _WORKERS[path] = _Worker(path)
        for batch in text_groups(batches):
            pieces, words = _WORKERS[path].counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(pieces)], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens (greedy longest-match pieces of its words).

    Words are runs without ASCII white space, A-Z lowered. Null and empty texts have no words
    and no tokens. Null and repeated ids are kept. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(_count(vocabulary or vocabulary_path()), "doc_id bigint, n_words bigint, n_tokens bigint"), "token-counts")
