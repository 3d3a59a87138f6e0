"""Language identification by hierarchical discrimination.

A text's family is decided first, then one-versus-one linear support vector machines
separate the languages of that family by votes.  Features are hashed byte 3- and 5-grams
of the lower-cased letters, as shares of all grams, so a machine's value is the mean of
its weights over the grams: whole texts are scored with table look-ups only.

The machines are trained here, on about ``per_language`` labelled documents of each
language, chosen by a hash of the id (the documented bound of what goes to the driver).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without
labelled documents all are ``und``; with one language only, that is predicted; a tie of
votes goes to the larger summed margin, then to the first name; of more than
``MOST_LANGUAGES`` labels the commonest are learnt (a bound of the classifier); columns of
any name pass through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, ship, steps, trimmed
from .words import LOWER

UNKNOWN = "und"
PER_LANGUAGE = 300
#: Labels that are learnt, at most; a pair of labels without a family in common costs 256 KB.
MOST_LANGUAGES = 40
BITS = 15
#: Languages by family; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "uralic": "fi et hu se".split(),
    "celtic": "ga gd cy br".split(),
    "baltic": "lt lv".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi ur bn mr ne gu pa".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_BLANK = np.array([0x20 if b < 0x80 and not 0x61 <= b <= 0x7A else b for b in range(256)], np.uint8)


def _grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the 3-grams and 5-grams that begin at each byte."""
    raw = _BLANK[np.frombuffer(data.translate(LOWER), np.uint8)]
    # upper-case Latin-1 letters in UTF-8 are C3 80..9E; lower case lies 0x20 above
    upper = np.zeros(len(raw), bool)
    upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    raw = (raw + upper * np.uint8(0x20)).astype(np.uint32)
    three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    three = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    wide = (raw[:-4] * np.uint32(0x85EBCA6B)) ^ (raw[1:-3] * np.uint32(0xC2B2AE35)) ^ (raw[2:-2] * np.uint32(0x27D4EB2F))
    wide ^= (raw[3:-1] * np.uint32(0x165667B1)) ^ (raw[4:] * np.uint32(0x9E3779B1))
    five = ((wide * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)
    return three, five


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their shares for one whole text."""
    three, five = _grams(b"  " + text + b"  ")
    numbers, counts = np.unique(np.concatenate([three, five]), return_counts=True)
    return numbers.astype(np.int32), (counts / counts.sum()).astype(np.float32)


def has_letter(text: bytes) -> bool:
    if any(0x61 <= b <= 0x7A for b in set(text.translate(LOWER))):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8"))


def machine(rows: list, signs: np.ndarray, rounds: int = 30, cost: float = 10.0, scale: float = 30.0) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM by dual coordinate descent."""
    w = np.zeros((1 << BITS + 1) + 1)
    norms = np.array([scale * scale * float(v @ v) + 1 for _, v in rows])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = signs[i] * (scale * (w[at] @ v) + w[-1]) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - gradient / (norms[i] + 1 / (2 * cost)))
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w[at] += step * scale * v
                w[-1] += step
                alpha[i] = new
    w[:-1] *= scale
    return w.astype(np.float32)


class Model:
    """Families, languages, and a machine for each pair of either."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted({r[0] for r in rows}):
            self.families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        self.pairs: list[tuple[str, str]] = []
        tables = []
        family = [FAMILY_OF.get(r[0], r[0]) for r in rows]
        language = [r[0] for r in rows]
        for names, of in [(sorted(self.families), family), *[(langs, language) for langs in self.families.values()]]:
            for a, b in combinations(names, 2):
                own = [k for k, x in enumerate(of) if x in (a, b)]
                signs = np.array([1.0 if of[k] == a else -1.0 for k in own])
                self.pairs.append((a, b))
                tables.append(machine([rows[k][1:] for k in own], signs))
        self.tables = np.array(tables, np.float32).reshape(len(tables), (1 << BITS + 1) + 1)

    def margins(self, values: pa.Array) -> np.ndarray:
        """A machine's value for every text (rows) and pair (columns)."""
        out = np.zeros((len(values), len(self.pairs)), np.float32)
        texts = [b"  " + (v or b"") + b"  " for v in values.to_pylist()]
        three, five = _grams(b"".join(texts))
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for j, table in enumerate(self.tables):
            sum3 = np.concatenate([[0], np.cumsum(table[three], dtype=np.float64)])
            sum5 = np.concatenate([[0], np.cumsum(table[five], dtype=np.float64)])
            lo, hi = begin[:-1], begin[1:]
            n = (hi - 2 - lo) + np.maximum(hi - 4 - lo, 0)
            out[:, j] = (sum3[hi - 2] - sum3[lo] + sum5[np.maximum(hi - 4, lo)] - sum5[lo]) / n + table[-1]
        return out

    def _choice(self, names: list[str], row: np.ndarray) -> tuple[str, float]:
        """Winner by votes, and its smallest margin."""
        if len(names) == 1:
            return names[0], 9.0
        votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in combinations(names, 2):
            m = float(row[self.pairs.index((a, b))])
            votes[a if m >= 0 else b] += 1
            for x, s in ((a, m), (b, -m)):
                sums[x] += s
                least[x] = min(least[x], s)
        best = max(names, key=lambda x: (votes[x], sums[x]))
        return best, least[best]

    def predict(self, values: pa.Array) -> tuple[list[str], list[float]]:
        texts = values.to_pylist()
        margins = self.margins(values)
        langs, scores = [], []
        for k, text in enumerate(texts):
            if not text or not self.families or not has_letter(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            family, m1 = self._choice(sorted(self.families), margins[k])
            lang, m2 = self._choice(self.families[family], margins[k])
            langs.append(lang)
            scores.append(float(1 / (1 + np.exp(-2 * min(m1, m2)))))
        return langs, scores


def is_held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featurer(batches):
    for batch in batches:
        langs, numbers, shares = [], [], []
        names = batch.column("lang").to_pylist()
        for at, values in steps(batch.column("text")):
            for k, text in enumerate(values.to_pylist()):
                if has_letter(text):
                    n, s = features(text)
                    langs.append(names[at + k])
                    numbers.append(n)
                    shares.append(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(numbers, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "numbers", "shares"]
        )


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled documents outside the held-out fold."""
    ship(docs.sparkSession)
    rows = docs.where(~is_held_out(id_col)).select(
        F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    rows = rows.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang")).orderBy(F.desc("n_lang"), "lang").limit(MOST_LANGUAGES)
    share = F.least(F.lit(1_000_000), F.floor(F.lit(1_000_000 * per_language) / F.col("n_lang")) + 1)
    some = rows.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < share).select("text", "lang")
    got = some.mapInArrow(trimmed(_featurer), "lang string, numbers array<int>, shares array<float>").toArrow().combine_chunks()
    names = got.column("lang").to_pylist()
    if not names:
        return Model([])
    lists = got.column("numbers").combine_chunks()
    ends = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    numbers, shares = lists.flatten().to_numpy(), got.column("shares").combine_chunks().flatten().to_numpy()
    vectors = [(name, numbers[a:b], shares[a:b]) for name, a, b in zip(names, ends, ends[1:])]
    return Model(sorted(vectors, key=lambda r: (r[0], len(r[1]), r[1].tobytes()[:400], r[2].tobytes()[:400])))


def _predictor(model, text_col: str, names: list[str], out: str):
    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for _, values in steps(batch.column(text_col)):
                got = model.value.predict(values)
                langs += got[0]
                scores += got[1]
            found = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], names=[*names, out])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (lang_pred, score), and its name; no shuffle."""
    ship(docs.sparkSession)
    names, out = list(docs.columns), fresh(docs, "language")
    found = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(trimmed(_predictor(shipped, text_col, names, out)), T.StructType([*docs.schema.fields, T.StructField(out, found)])), out


def keep_identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Documents whose language could be told; others (no text, no letter) go."""
    found, name = identify(docs, train(docs, per_language))
    return found.where(F.col(name)["lang_pred"] != UNKNOWN).drop(name)
