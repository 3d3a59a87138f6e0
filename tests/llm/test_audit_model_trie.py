"""Divergence audit, quality model and conversation trie against brute force, with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldwright.llm import conversation_trie, divergence, quality_model

ODD = "doc_id long, text string, lang string, source string, n_chars long, term string, item string, n int, label int"


def audit_rows(docs, least, top=50):
    """The contract, literally, over dense counts."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(lower))
        counts[lang, source].update(found)
        held[lang].update(set(found))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def audit_docs():
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("Ab", "cé", "日本", "x") for b in "abcdefghij"]
    docs = []
    for k in range(160):
        some = rng.zipf(1.4, rng.integers(0, 40)) % len(words)
        docs.append((k, " ".join(words[i] + ",.7 "[k % 4] for i in some), ["en", "de", None][k % 3], ["a", "b", "é", None, "a"][rng.integers(0, 5)], k))
    docs += [(1, None, "en", "c", 1), (None, "", "en", "c", None), (2, " 12 @ ", "fr", "only", 2), (3, "Ab ab AB aB", "fr", "other", 3), (4, "ab " * 30000, "en", "long", 4), (4, "ab " * 30000, "en", "long", 4)]
    return [(*d, "t", "i", 1, 2) for d in docs]


def test_divergence_is_the_contract(spark):
    docs = audit_docs()
    df = spark.createDataFrame(docs, ODD).repartition(5)
    for least, top in ((1, 3), (7, 50), (30, 50), (200, 50)):
        got = sorted(tuple(r) for r in divergence.audit(df, least, top).collect())
        assert got == audit_rows(docs, least, top), least
    assert divergence.audit(df.where("false")).collect() == []


def test_sketch_never_underestimates_and_prunes(spark):
    docs = [(k, f"often rare{chr(97 + k // 26)}{chr(97 + k % 26)}", "en", "s", 0, "", "", 0, 0) for k in range(600)]
    rows = spark.createDataFrame(docs, ODD).select("lang", "source", "text").repartition(7)
    assert {r["term"]: (r["n"], r["docs"]) for r in divergence.term_counts(rows, 30, 1 << 22).collect()} == {"often": (600, 600)}
    # a sketch far too small keeps more, never less
    tight = {r["term"]: r["n"] for r in divergence.term_counts(rows, 30, 0, 1 << 14).collect()}
    assert tight["often"] == 600
    big = divergence.share(F.lit(9 * 10**17), F.lit(9 * 10**17), F.lit(10**6))
    assert spark.range(1).select(big).head()[0] == 1 + 10**9 * (9 * 10**17 + 5) // (9 * 10**17 + 5 * 10**6)


def naive_features(text: bytes) -> int:
    kind = lambda b: 0 if b <= 0x20 or b == 0x7F else 1 if b >= 0x80 or chr(b).isalnum() else 2
    words = []
    for at, b in enumerate(text):
        if kind(b) and (not at or kind(text[at - 1]) != kind(b)):
            words.append(b"")
        if kind(b):
            words[-1] += bytes([b])
    return words


def test_quality_features_match_plain_words():
    texts = ["", "One two  two,, x9 é!", "###", "a", "A B", "one two two", "tail. "]
    f = quality_model.Features(pa.array([t.encode() for t in texts], pa.large_binary()))
    for k, t in enumerate(texts):
        n = len(naive_features(t.encode()))
        assert (f.text == k).sum() == 2 * n + 2 * max(0, n - 1), t
        assert f.length[k] - (1 << quality_model.BITS) == int(np.ceil(np.log2(n + 1)))
    one = quality_model.Features(pa.array([texts[1].encode()], pa.large_binary()))
    assert sorted(one.number) == sorted(f.number[f.text == 1])  # neighbours do not matter
    text, _, value = f.counted()
    assert np.allclose(np.bincount(text, value**2)[np.unique(text)], 1)


def test_follow_the_leader_is_the_plain_update():
    rng = np.random.default_rng(5)
    z, n = np.zeros(6), np.zeros(6)
    slow_z, slow_n = [0.0] * 6, [0.0] * 6
    for _ in range(30):
        at, value, label = rng.choice(6, 3, replace=False), rng.random(3), int(rng.integers(0, 2))
        quality_model.follow(z, n, at, value, label)
        w = {i: -slow_z[i] / ((quality_model.BETA + slow_n[i] ** 0.5) / quality_model.ALPHA + quality_model.L2) for i in at}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, value))))
        for i, v in zip(at, value):
            g = (p - label) * v
            slow_z[i] += g - ((slow_n[i] + g * g) ** 0.5 - slow_n[i] ** 0.5) / quality_model.ALPHA * w[i]
            slow_n[i] += g * g
    assert np.allclose(z, slow_z) and np.allclose(n, slow_n)


def test_quality_model_learns_outside_the_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality_model.train(docs, labels)
    again = quality_model.train(docs.repartition(3), labels.repartition(5))
    assert np.array_equal(weights, again)  # not by partitions
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    spoiled = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(weights, quality_model.train(docs, spoiled))  # held-out labels teach nothing
    scored, name = quality_model.score(docs, weights)
    rows = scored.join(labels, "doc_id").where(quality_model.is_held_out()).select(name, "quality").collect()
    assert len(rows) > 80 and np.mean([(s >= 0.5) == q for s, q in rows]) > 0.97
    assert all(s >= 0.5 for s, q in rows if q == 1)


def test_quality_model_awkward_rows(spark):
    rows = [(1, "good plain words here", "x"), (1, "another text", "x"), (2, None, None), (3, "", "y"), (None, "### $$$", "z"), (4, "### $$$ " * 20000, "z"), (5, "### !!! ###", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _quality string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, None), (3, 1), (4, 0), (5, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    weights = quality_model.train(docs, labels)
    out, name = quality_model.score(docs, weights)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r[name] <= 1 for r in got) and out.columns[:3] == docs.columns
    assert {r["_quality"] for r in got} == {"x", "y", "z", None}
    by = {r["text"]: r[name] for r in got}
    assert by[None] == by[""]
    assert not quality_model.train(docs, labels.where("false")).any()
    assert quality_model.score(docs.where("false"), weights)[0].collect() == []
    picked = {r["label"]: r["text"] for r in quality_model.labelled(docs, labels.where("doc_id = 1"), 10, "doc_id", "text", "quality").collect()}
    assert picked == ({1: "another text"} if zlib.crc32(b"1") % 3 != 1 else {})


def trie_rows(turns):
    """The contract over plain sequences."""
    convs = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    key = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
    convs = {c: [(r, x) for *_, r, x in sorted(v, key=lambda y: (y[0], y[1], y[2].encode(), key(y[2], y[3])))] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves, saved = (sum(below[k][0] for k in children[node]) or 1), own + sum(below[k][1] for k in children[node])
        below[node] = leaves, saved
        ended = sorted(c for c in members[node] if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


CONV = "conv_id long, turn long, role string, text string, node long, key string, n_convs int"


def check_trie(spark, turns):
    df = spark.createDataFrame([(*t, 1, "k", 2) for t in turns], CONV).repartition(3)
    found = conversation_trie.trie(conversation_trie.with_shared_starts(conversation_trie.conversations(df)))
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: (r[1], r[0])) == trie_rows(turns)


def test_trie_small_cases(spark):
    assert conversation_trie.trie(conversation_trie.with_shared_starts(conversation_trie.conversations(spark.createDataFrame([], CONV)))).collect() == []
    check_trie(spark, [(7, 0, "u", "alone")])
    turns = [(c, t, "ua"[t % 2], f"turn {t} {c % 3 if t > 2 else ''}é") for c in (0, 1, 2, 5, 6, 8, 11, 14, 20, 21) for t in range(4)]
    turns += [(3, None, "u", "null first"), (3, 0, None, None), (3, 0, "u", "tie"), (3, 0, "a", "tie"), (3, 5, "u", ""), (None, 0, "u", "nobody"), (9, 0, "u", "x"), (9, 0, "u", "x")]
    turns += [(30 + k, t, "u", f"copy {t}") for k in range(12) for t in range(20)] + [(47, 0, "u", "9" * 100_000)]
    check_trie(spark, turns)


def test_trie_with_hot_and_cold_nodes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    turns = [(int(c), t, "u", f"w{rng.zipf(1.5) % 4}") for c in rng.permutation(120) for t in range(int(rng.integers(1, 7)))]
    for hot, piece in ((1000, 4096), (4, 7)):
        monkeypatch.setattr(conversation_trie, "HOT", hot)
        monkeypatch.setattr(conversation_trie, "PIECE", piece)
        check_trie(spark, turns)
