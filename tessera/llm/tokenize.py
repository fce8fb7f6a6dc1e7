"""Exact token ids of a public byte-pair tokenizer, with each distinct word encoded once a worker.

The pre-tokenizer of the vocabulary never joins what a space or a line feed parts, and the
normalizer maps every such run to one space; so a text's ids are those of its chunks between
spaces and line feeds, in order. Arrow splits a batch of texts and numbers its distinct
chunks; only chunks that the worker has not met go to the tokenizers library, many in a call.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Chunks that a worker remembers; beyond this it keeps the half that most groups of texts held, so its memory stays bounded.
CACHE_CHUNKS = 400_000
#: The vocabulary's own split pattern, as RE2 writes it.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"
#: Chunks of these characters are their own NFC form and have no special case mapping.
_SIMPLE = r"^[!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*$"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level_map() -> dict[int, str]:
    """What byte-level pre-tokenizers write for each byte; the printable ones stay, the others follow from 256 on. The space stays too."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(others)} | {32: " "}


def _spaced(lower: pa.Array) -> np.ndarray:
    """Lower-case chunks with a space behind each of their pieces; letters with or without one mark behind them need no search for pieces."""
    body, last = pc.utf8_slice_codeunits(lower, 0, -1), pc.utf8_slice_codeunits(lower, -1, None)
    word = pc.utf8_is_alpha(lower)
    marked = pc.and_(pc.utf8_is_alpha(body), pc.is_in(last, pa.array(list(".,;:!?"), pa.large_string())))
    blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    out = pc.if_else(word, pc.binary_join_element_wise(lower, blank, none), pc.binary_join_element_wise(body, last, none, blank)).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~pc.or_(word, marked).to_numpy(zero_copy_only=False))
    if len(rest):
        out[rest] = pc.replace_substring_regex(lower.take(pa.array(rest)), _PIECE, r"\1 ").to_numpy(zero_copy_only=False)
    return out


class BatchEncoder:
    """Encodes columns of texts to the ids that the tokenizer file gives with add_special_tokens=False."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._words = Tokenizer(self._whole.model)
        self._words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self._whole.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._letters = np.array([ord(c) for _, c in sorted((byte_level_map() | {10: "\n"}).items())], dtype="<u4")
        self._most = cache_chunks
        self._at: dict[str, int] = {}
        self._start = np.zeros(1024, dtype=np.int64)
        self._length = np.zeros(1024, dtype=np.int64)
        self._met = np.zeros(1024, dtype=np.int32)
        self._pool = np.zeros(4096, dtype=np.uint32)
        self._used = 0

    def _forget(self) -> None:
        """Keep the half of the chunks that were met most often."""
        n = len(self._at)
        keep = np.sort(np.argsort(-self._met[:n], kind="stable")[: n // 2])
        chunks = list(self._at)
        self._at = {chunks[k]: i for i, k in enumerate(keep.tolist())}
        start, length = self._start[keep], self._length[keep]
        ends = np.append(0, np.cumsum(length))
        self._pool[: ends[-1]] = self._pool[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
        self._start[: len(keep)], self._length[: len(keep)], self._met[: len(keep)] = ends[:-1], length, self._met[keep] // 2
        self._met[len(keep) :] = 0
        self._used = int(ends[-1])

    def _learn(self, chunks: np.ndarray) -> None:
        column = pa.array(chunks, pa.large_string())
        simple = pc.match_substring_regex(column, _SIMPLE).to_numpy(zero_copy_only=False)
        spaced = _spaced(pc.utf8_lower(column))
        special = {}
        for k in np.flatnonzero(~simple | (pc.find_substring(column, "<|").to_numpy(zero_copy_only=False) >= 0)):
            if "<|" in chunks[k]:  # may hold an added token, which the whole tokenizer finds first
                special[k] = self._whole.encode(chunks[k], add_special_tokens=False).ids
                spaced[k] = ""
            else:
                spaced[k] = "".join(f"{p} " for p, _ in self._whole.pre_tokenizer.pre_tokenize_str(self._whole.normalizer.normalize_str(chunks[k])))
                simple[k] = False
        wide = np.flatnonzero(simple & (pc.string_is_ascii(column).to_numpy(zero_copy_only=False) == 0))
        if len(wide):  # none holds a line feed
            spaced[wide] = self._letters[np.frombuffer("\n".join(spaced[wide]).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\n")
        counts = pc.count_substring(pa.array(spaced, pa.large_string()), " ").to_numpy()
        cut = pa.array("".join(spaced).split(" ")[:-1], pa.large_string()).dictionary_encode()
        pieces = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = np.concatenate([np.asarray(self._words.encode_batch_fast([" ".join(pieces[i : i + 2000])], add_special_tokens=False)[0].ids, dtype=np.uint32) for i in range(0, len(pieces), 2000)] or [np.zeros(0, np.uint32)])
        ends = np.append(0, np.flatnonzero(self._ends[ids]) + 1)
        if len(ends) != len(pieces) + 1:
            raise ValueError("the vocabulary does not mark the ends of words")
        piece = cut.indices.to_numpy()
        first, size = ends[:-1][piece], np.diff(ends)[piece]
        ends = np.append(0, np.cumsum(size))
        ids = ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        upto = np.append(0, np.cumsum(counts))
        start, length = ends[upto[:-1]], ends[upto[1:]] - ends[upto[:-1]]
        for k, own in special.items():
            start[k], length[k] = len(ids), len(own)
            ids = np.append(ids, np.asarray(own, dtype=np.uint32))
        n, base = len(self._at), self._used
        while self._used + len(ids) > len(self._pool):
            self._pool = np.append(self._pool, np.zeros(len(self._pool), dtype=np.uint32))
        while n + len(chunks) > len(self._start):
            self._start, self._length, self._met = (np.append(x, np.zeros_like(x)) for x in (self._start, self._length, self._met))
        self._pool[base : base + len(ids)] = ids
        self._start[n : n + len(chunks)], self._length[n : n + len(chunks)] = start + base, length
        self._used += len(ids)
        self._at.update(zip(chunks, range(n, n + len(chunks))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column without nulls, and where each text's ids begin and end."""
        parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py() if len(parts) else np.zeros(1, dtype=np.int64)
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self._at) > self._most:
            self._forget()
        where = np.fromiter(map(self._at.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        if len(new := np.flatnonzero(where < 0)):
            self._learn(distinct[new])
            where[new] = np.arange(len(self._at) - len(new), len(self._at))
        self._met[where] += 1
        chunk = where[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
        length = self._length[chunk]
        ends = np.append(0, np.cumsum(length))
        ids = self._pool[np.repeat(self._start[chunk] - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[bounds]


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """This worker's encoder for a vocabulary file; workers are reused over tasks, and so is what they know."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Free what this worker's encoders know; for stages that encode nothing."""
    _ENCODERS.clear()
