"""Token ids of whole texts by the tokenizers library, each distinct chunk encoded once per worker process.

A text is cut only where every one of the supported pre-tokenizers cuts too, so the ids of the chunks, put
together, are the ids of the text:

* byte-level files: before an ASCII white-space byte that a byte which cannot begin a white-space character
  follows (a pre-token takes at most the last white-space character of a run, and none holds white space after
  another character), and after it unless it is a space (only a space joins the word that it precedes);
* word files (white space dropped, nothing joined across it): around every run of ASCII white space;
* both: between a Latin letter, an ASCII digit and an ASCII sign, but never after an apostrophe (``'s`` is one
  pre-token) and not in slices that hold ``<|``, with which the special tokens begin.

A chunk of Latin letters is one pre-token, so the library's model encodes it without the steps before; any other
chunk goes through the whole tokenizer.  Repeated words cost a hash and a look-up.
"""

from __future__ import annotations

import importlib.util
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from veracet.llm.words import IS_SPACE, LOWER, joined, prefix_hash, range_hash, slices, spread

#: Folder of the vocabulary files; VERACET_TOKENIZERS or an argument names another.
FOLDER = os.environ.get("VERACET_TOKENIZERS", "/opt/tokenizers")
#: A worker's table of chunks starts anew beyond this many chunks.
MOST_CHUNKS = 1_000_000

# Bytes after which a byte-level file is not cut: white space, information separators, and the first bytes of
# U+0085, U+00A0, U+1680, U+2000-U+205F and U+3000.
_MAYBE_SPACE = IS_SPACE.copy()
_MAYBE_SPACE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True

_KIND = np.zeros(256, np.uint8)  # 0: no cut beside it, 1: letter, 2: sign, 3: digit, 4: apostrophe
_KIND[33:127] = 2
_KIND[48:58] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[0x27] = 4


def _kind_changes(data: np.ndarray) -> np.ndarray:
    """At i: whether to cut between the bytes i - 1 and i."""
    kind = _KIND[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0-U+00FF without the two signs of arithmetic
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = 1
    a, b = kind[:-1], kind[1:]
    out = np.zeros(len(data) + 1, bool)
    out[1:-1] = (a != b) & (a > 0) & (b > 0) & (a != 4) & ~((a == 2) & (b == 4))
    return out


def _byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others
    numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


_CHARACTERS = _byte_characters()


def tokenizer_path(name: str) -> str:
    """``public_tokenizers.path(name)``: from that package if it can be imported, else from ``FOLDER``."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{FOLDER}/__init__.py")
    if spec and os.path.exists(f"{FOLDER}/__init__.py"):
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module.path(name)
    return os.path.join(FOLDER, name)


class ChunkTokenizer:
    """Encodes Arrow text columns; ``joins_space`` tells a byte-level file from one that drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.joins_space = self.tokenizer.normalizer is None
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.raw_at = np.zeros(0, np.int64)
        self.raw_length = np.zeros(0, np.int64)
        self.raw = np.zeros(0, np.uint8)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.key) + len(keys) > MOST_CHUNKS:
            self._reset()
        ids: list[int] = []
        length = np.empty(len(texts), np.int64)
        model, space = self.tokenizer.model, " " if self.joins_space else ""
        for i, text in enumerate(texts):
            letters = text.removeprefix(space)
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0100"):
                word = text if space else text.lower()
                got = [x.id for x in model.tokenize(word.encode().decode("latin-1").translate(_CHARACTERS))]
            else:
                got = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids += got
            length[i] = len(got)
        at = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate((self.flat, np.asarray(ids, np.uint32)))
        key = np.concatenate((self.key, keys))
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.at = np.concatenate((self.at, at))[order]
        self.length = np.concatenate((self.length, length))[order]
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_at = np.concatenate((self.raw_at, len(self.raw) + np.cumsum(size) - size))[order]
        self.raw_length = np.concatenate((self.raw_length, size))[order]
        self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(raw), np.uint8)))

    def _same(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> bool:
        """Whether the chunks of data are those that the table has at these places, byte by byte."""
        if not np.array_equal(length, self.raw_length[place]):
            return False
        return np.array_equal(data[spread(start, length)], self.raw[spread(self.raw_at[place], length)])

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, text by text without the table."""
        ids = [self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in column.to_pylist()]
        return np.array([i for row in ids for i in row], np.uint32), np.array([len(row) for row in ids], np.int64)

    def _chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Data, each chunk's place in it, and of each row the first chunk."""
        data, offsets = joined(column)
        if not len(data):
            return data, offsets[:0], offsets[:0], np.zeros(len(column) + 1, np.int64)
        special = b"<|" in data.tobytes()
        if not self.joins_space:
            if not special:
                data = LOWER[data]
            space = IS_SPACE[data]
            cut = np.zeros(len(data) + 1, bool) if special else _kind_changes(data)
            cut[1:-1] |= space[1:] != space[:-1]
            cut[0] = cut[-1] = True
            edge = np.flatnonzero(cut)
            start, end = edge[:-1], edge[1:]
            word = ~space[start]
            start, end = start[word], end[word]
            return data, start, end, np.searchsorted(start, offsets)
        head, tail = offsets[:-1], offsets[1:] - 1  # the line feed that ends each row is no part of it
        cut = np.zeros(len(data) + 1, bool) if special else _kind_changes(data)
        before = IS_SPACE[data[:-1]] & ~_MAYBE_SPACE[data[1:]]
        cut[:-2] |= before
        cut[1:-1] |= before & (data[:-1] != 0x20)
        cut[head] = cut[tail] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data))
        first = np.searchsorted(start, offsets)
        # drop the chunks that are only the line feeds put in between, one for each row
        last = np.searchsorted(start, tail)
        keep = np.ones(len(start), bool)
        keep[last] = False
        return data, start[keep], end[keep], first - np.arange(len(first))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, one after the other, and each row's count."""
        data, start, end, first = self._chunks(column)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        key = range_hash(prefix_hash(data), start, end)
        unique, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        for attempt in range(2):
            place = np.searchsorted(self.key, unique)
            known = np.zeros(len(unique), bool)
            inside = place < len(self.key)
            known[inside] = self.key[place[inside]] == unique[inside]
            new = np.arange(len(unique)) if attempt else np.flatnonzero(~known)
            if not len(new):
                break
            if not attempt and len(self.key) + len(new) > MOST_CHUNKS:
                self._reset()
                continue
            raw = data.tobytes()
            s, e = start[where[new]].tolist(), end[where[new]].tolist()
            self._learn(unique[new], [raw[i:j].decode() for i, j in zip(s, e, strict=True)])
            place = np.searchsorted(self.key, unique)
            break
        first_of = where[inverse]
        alike = np.array_equal((end - start)[first_of], end - start) and np.array_equal(data[spread(start[first_of], end - start)], data[spread(start, end - start)])
        if not alike or not self._same(data, start[where], (end - start)[where], place):
            return self._plain(column)  # two chunks with one hash
        place = place[inverse]
        length = self.length[place]
        ids = self.flat[spread(self.at[place], length)]
        to = np.concatenate(([0], np.cumsum(length)))[first]
        return ids, np.diff(to)


@lru_cache(4)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process, kept over its tasks."""
    return ChunkTokenizer(path)


def encoded(column: pa.Array, path: str, end_id: int):
    """For slices of a text column: first row, last row, all ids with ``end_id`` after each row, counts."""
    t = chunk_tokenizer(path)
    for a, b in slices(column):
        ids, count = t.encode(column.slice(a, b - a))
        count = count + 1
        to = np.cumsum(count)
        out = np.empty(int(to[-1]), np.uint32)
        mine = np.ones(len(out), bool)
        mine[to - 1] = False
        out[mine] = ids
        out[to - 1] = end_id
        yield a, b, out, count


__all__ = ["ChunkTokenizer", "chunk_tokenizer", "encoded", "tokenizer_path"]
