"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as one token are
the whole tokens.  A pre-token among them counts one without any merging; only the others
are merged, by the library.  Texts are first cut where a pre-token ends whatever follows:
before white space that follows something else, before a space that something else
follows, and after a lone line end.  Arrow numbers the distinct pieces and a bounded table
keeps their counts.

Defined cases: a null text is empty (0 bytes, 0 tokens); special strings in a text are
special tokens, as the library has it, and part the text; only pieces with white space
beyond ASCII's are encoded whole; repeated rows are counted row by row; other columns are
not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import ship, steps, text_rows
from .tokenize import ENCODE_BYTES, MOST_PIECES, PieceTable, distinct, encoded, library, opened, path_of

LIMIT = 1024

#: Fixed value: the vocabulary's pre-token pattern.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space beyond ASCII's, and control characters that only some hold to be white space.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: Bytes that may belong to white space of the unusual kind.
_MAYBE = np.array([0x1C <= b <= 0x1F or 0x80 <= b <= 0xAF or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that alone encode as exactly one token (proved by encoding each)."""
    encode = library(path)
    n = encode.get_vocab_size()
    texts = [encode.decode([i], skip_special_tokens=False) for i in range(n)]
    found = set()
    for lo in range(0, n, 10_000):
        for text, got in zip(texts[lo : lo + 10_000], encode.encode_batch_fast(texts[lo : lo + 10_000], add_special_tokens=False)):
            if len(got.ids) == 1 and "�" not in text:
                found.add(text)
    return frozenset(found)


def cuts(data: bytes, offs: np.ndarray) -> np.ndarray:
    """Where pieces begin whose counts add up to those of the texts."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    solid = ~space & ~_MAYBE[raw]
    begin = np.zeros(len(raw), bool)
    begin[1:] = space[1:] & solid[:-1]
    # a space before something solid; lead bytes of the unusual kind hide behind the next byte
    begin[:-1] |= (raw[:-1] == 0x20) & solid[1:]
    if len(raw) > 2:
        lone = (raw[1:-1] != 0x20) & space[1:-1] & solid[:-2] & solid[2:]
        begin[2:] |= lone
    begin[offs[offs < len(raw)]] = True
    return np.flatnonzero(begin)


class Counter:
    """Counts tokens of whole texts; ``whole`` holds the proved whole tokens."""

    TOGETHER = 64

    def __init__(self, path: str, whole: frozenset[str], most: int = MOST_PIECES):
        import regex

        self.library, self.whole = library(path), whole
        specials = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(specials).encode()) if specials else None
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        names = self.library.get_vocab()
        self.begins_word = np.zeros(max(names.values()) + 1, bool)
        self.begins_word[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.table, self.counts = PieceTable(most), np.zeros(0, np.int64)

    def _merged(self, tokens: list[str]) -> dict[str, int]:
        """Count by merging, for pre-tokens that are no whole token.  Those with a space in front
        are merged many to a string and told apart by it."""
        spaced = [t for t in tokens if t[0] == " " and not t.isspace()]
        ids, _ = encoded(self.library, ["".join(spaced[k : k + self.TOGETHER]) for k in range(0, len(spaced), self.TOGETHER)])
        begins = np.flatnonzero(self.begins_word[ids])
        out = {}
        if len(begins) == len(spaced):
            out = dict(zip(spaced, np.diff(begins, append=len(ids)).tolist()))
        rest = [t for t in tokens if t not in out]
        return out | dict(zip(rest, encoded(self.library, rest)[1].tolist()))

    def _learn(self, new: list[bytes]) -> None:
        keys = [k.decode("utf-8") for k in new]
        odd = [k for k in keys if _UNUSUAL.search(k)]
        split = [None if _UNUSUAL.search(k) else self.pre_tokens(k) for k in keys] if odd else list(map(self.pre_tokens, keys))
        whole = self.whole
        merged = self._merged(list({t: None for own in split if own for t in own if t not in whole}))
        others = dict(zip(odd, encoded(self.library, odd)[1].tolist()))
        counts = [others[k] if own is None else sum(1 if t in whole else merged[t] for t in own) for k, own in zip(keys, split)]
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])

    def count(self, values: pa.Array) -> np.ndarray:
        data, offs = opened(values)
        text_at, extra = offs, np.zeros(len(values), np.int64)
        if self.special and (found := [m.span() for m in self.special.finditer(data)]):
            # each special string is one token and parts its text; none reaches over two texts
            spans = np.array(found, np.int64)
            own = np.searchsorted(offs, spans[:, 0], "right") - 1
            inside = spans[:, 1] <= offs[own + 1]
            spans, own = spans[inside], own[inside]
            extra = np.bincount(own, minlength=len(values))
            offs = np.unique(np.concatenate([offs, spans.ravel()]))
        else:
            spans = np.zeros((0, 2), np.int64)
        starts = cuts(data, offs)
        if not len(starts):
            return extra
        numbers, keys = distinct(data, starts)
        codes, new = self.table.number(keys, np.bincount(numbers, minlength=len(keys)))
        if new:
            self._learn(new)
        own = self.counts[codes[numbers]]
        at = np.searchsorted(starts, spans[:, 0])
        own[at] = 0  # special strings are counted above
        total = np.concatenate([[0], np.cumsum(own)])[np.searchsorted(starts, text_at)]
        if (kept := self.table.forget(new)) is not None:
            self.counts = self.counts[kept]
        return total[1:] - total[:-1] + extra


_counters: dict[str, Counter] = {}


def _counter(path: str, whole: frozenset[str]) -> Counter:
    """This process's counter: its table serves all tasks that a worker runs."""
    if path not in _counters:
        _counters[path] = Counter(path, whole)
    return _counters[path]


def _mapper(path: str, whole, limit: int):
    def run(batches):
        for batch in batches:
            counter = _counter(path, whole.value)
            sizes, counts = [], []
            for _, values in steps(batch.column("text"), ENCODE_BYTES):
                sizes.append(pc.binary_length(values).to_numpy(zero_copy_only=False))
                counts.append(counter.count(values))
            n_bytes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
            n_tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row; no shuffle.

    What is broadcast are the whole tokens of one vocabulary, never more than its size."""
    ship(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    vocabulary = vocabulary or path_of("byte_bpe_50k.json")
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_mapper(vocabulary, whole, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
