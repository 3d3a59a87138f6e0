"""Encoding and counting with public tokenizers, a piece of text at a time.

Both vocabularies split a text into pre-tokens that never span a run of white space, so
the pieces between white space can be encoded alone.  Pieces repeat: Arrow numbers the
distinct ones of a slice of texts, a worker keeps the ids of those it has met in a bounded
table, and the library is asked for new ones only.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import LOWER, NOT_SPACE

#: Fixed value: the id appended to each document.
END = 2
#: Entries of a worker's table (about 25 MB); beyond that the less used half is forgotten.
MOST_PIECES = 150_000
#: Bytes of a piece that may be kept; a longer one is encoded again each time.
LONG_PIECE = 64
#: Bytes of text encoded by one vectorised step.
ENCODE_BYTES = 4 << 20


def path_of(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceTable:
    """Numbers of the pieces that a worker has met, and how often; bounded."""

    def __init__(self, most: int):
        self.most, self.codes, self.uses = most, {}, np.zeros(0, np.int64)

    def number(self, keys: list[bytes], times: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each key, and the keys that are new, in the order of their numbers."""
        known = self.codes.get
        codes = np.fromiter((known(k, -1) for k in keys), np.int64, len(keys))
        missing = np.flatnonzero(codes < 0)
        new = [keys[i] for i in missing.tolist()]
        codes[missing] = len(self.codes) + np.arange(len(new))
        self.codes.update(zip(new, codes[missing].tolist()))
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[codes] += times
        return codes, new

    def forget(self, new: list[bytes]) -> np.ndarray | None:
        """Drop long new keys and, from a full table, the less used half; the numbers of those
        kept, in their new order, or None where all stay."""
        if len(self.codes) <= self.most and max(map(len, new), default=0) <= LONG_PIECE:
            return None
        keys = list(self.codes)
        order = np.flatnonzero(np.fromiter((len(k) <= LONG_PIECE for k in keys), bool, len(keys)))
        if len(order) > self.most:
            order = np.sort(order[np.argsort(-self.uses[order], kind="stable")[: self.most // 2]])
        self.uses = self.uses[order] // 2
        self.codes = {keys[i]: n for n, i in enumerate(order.tolist())}
        return order


def encoded(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The library's ids of all texts end to end, and how many each has."""
    got = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes


def distinct(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of the piece from each start to the next, and the distinct pieces."""
    bounds = pa.py_buffer(np.concatenate([starts, [len(data)]]).astype(np.int64))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
    return pieces.indices.to_numpy(), pieces.dictionary.to_pylist()


def opened(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts end to end, and their offsets."""
    offs = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    whole = values.buffers()[2]
    data = bytes(memoryview(whole)[int(offs[0]) : int(offs[-1])]) if whole is not None else b""
    return data, offs - offs[0]


@cache
def word_encoder(path: str) -> "WordEncoder":
    """This process's encoder: its table serves all tasks that a worker runs."""
    return WordEncoder(path)


class WordEncoder:
    """Ids of whole texts with a lower-casing word vocabulary.

    The normaliser and the pre-tokenizer work within what lies between ASCII white space
    (no composition, no special string and no pre-token reaches over it, and it yields no
    token), so a text's ids are those of its pieces in turn.  New pieces go to the library
    in strings of ``TOGETHER`` pieces; their ids are told apart by the ids that end words."""

    TOGETHER = 64
    # Latin-1 without no-break space and the digits beyond ASCII: lower case, then letters, digits and the rest split alone.
    _PLAIN = re.compile("[!-~¡-±´-¸º»¿-ÿ]+")
    _PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9]|[^a-z0-9ªµºß-öø-ÿ]+")

    def __init__(self, path: str, most: int = MOST_PIECES):
        self.library, self.table = library(path), PieceTable(most)
        names = self.library.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _words_in(self, text: str) -> int:
        """Pre-tokens of a piece; 0 where only the library can tell."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return 0
        if text.isalpha():
            return 1
        return len(self._PARTS.findall(text.lower())) if self._PLAIN.fullmatch(text) and "<|" not in text else 0

    def _learn(self, new: list[bytes]) -> None:
        texts = [key.strip().decode("utf-8") for key in new]  # ASCII white space only
        counts = np.fromiter(map(self._words_in, texts), np.int64, len(texts))
        sizes = np.zeros(len(texts), np.int64)
        plain, odd = np.flatnonzero(counts), np.flatnonzero(counts == 0)
        some = [texts[i] for i in plain.tolist()]
        ids, _ = encoded(self.library, [" ".join(some[k : k + self.TOGETHER]) for k in range(0, len(some), self.TOGETHER)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == counts.sum():
            sizes[plain] = np.diff(ends[np.cumsum(counts[plain]) - 1], prepend=0)
        else:  # not told apart by their ends: one by one
            plain, odd, ids = plain[:0], np.arange(len(texts)), ids[:0]
        odd_ids, sizes[odd] = encoded(self.library, [texts[i] for i in odd.tolist()])
        both = np.concatenate([plain, odd])
        ids, after = laid(np.argsort(both), np.concatenate([ids, odd_ids]), np.concatenate([[0], np.cumsum(sizes[both])]))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + after[1:]])

    def encode(self, values: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8) end to end, and the offsets of each; ``end`` is appended to each text."""
        data, offs = _spread(*opened(values))
        starts, first = _word_starts(data, offs)
        numbers, keys = distinct(data, starts)
        codes, new = self.table.number(keys, np.bincount(numbers, minlength=len(keys)))
        if new:
            self._learn(new)
        ids, after = laid(codes[numbers], self.ids, self.ends)
        offsets = after[first]
        if end is not None:
            ids = np.insert(ids, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
        if (kept := self.table.forget(new)) is not None:
            self.ids, self.ends = laid(kept, self.ids, self.ends)
        return ids, offsets


def _word_starts(data: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces between white space begin, and where each text's pieces do."""
    inside = NOT_SPACE[np.frombuffer(data, np.uint8)]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offs[(offs > 0) & (offs < len(data))]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offs)


_SYMBOL = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)])


def _spread(data: bytes, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts end to end, in lower case, with a space between a letter and a symbol behind it;
    pre-tokens stay the same and pieces repeat more often.  Returns the texts' offsets too.

    A pre-token of letters always ends before a symbol.  Slices with the beginning of a
    special string stay as they are: there case and closeness tell."""
    if b"<|" in data or len(data) < 3:
        return data, offs
    raw = np.frombuffer(data.translate(LOWER), np.uint8)
    mark = _SYMBOL[raw]
    mark[:2] = False
    at = np.flatnonzero(mark)
    before, lead = raw[at - 1], raw[at - 2]
    letter = (before >= 0x61) & (before <= 0x7A)
    letter |= (lead == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7)
    mark[at[~letter]] = False
    mark[offs[offs < len(raw)]] = False  # a text's first character stays its own
    at = np.flatnonzero(mark)  # few: all else is a byte or a bit for each byte of text
    out = np.full(len(raw) + len(at), 0x20, np.uint8)
    own = np.ones(len(out), bool)
    own[at + np.arange(len(at))] = False
    out[own] = raw
    return out.tobytes(), offs + np.searchsorted(at, offs)


def laid(codes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries end to end, and where each ends (from 0)."""
    first = ends[codes]
    sizes = ends[codes + 1] - first
    after = np.concatenate([[0], np.cumsum(sizes)])
    kind = np.int32 if max(len(ids), int(after[-1])) < 2**31 else np.int64
    at = np.repeat((first - after[:-1]).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return ids[at], after
