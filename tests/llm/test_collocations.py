"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import collocations as co
from lumenframe.llm.collocations import collocations

DOCS = "doc_id long, text string, lang string, n long, rank string, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, subsumed=50, top=2_000):
    counts, sizes, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {part for p, a in cands.items() if len(p) == 3 for part in (p[:2], p[1:]) if 100 * a >= subsumed * f[part]}
        best = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", "y") for i, (t, lang) in enumerate(rows)], DOCS)


def prose(seed, texts, words):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "été", "a", "日本", "x y", "--", "b\u001fc", "İ"] + [f"w{i}" for i in range(words)]
    weights = [30, 20, 9, 9, 6, 12, 5, 3, 3, 2, 2] + [1] * words
    marks = [" ", "  ", "\t", ". ", ", ", "\n", "! ", ";", "?:"]
    return [("".join(w + rng.choices(marks, [60, 5, 3, 4, 4, 3, 1, 1, 1])[0] for w in rng.choices(vocabulary, weights, k=rng.randint(0, 120))),
             rng.choices(["en", "de", None, "und"], [6, 2, 1, 1])[0]) for _ in range(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting(spark, seed):
    rows = prose(seed, 400, 30) + [("a a a a a " * 5, "en"), (None, "fr"), ("", None), ("...", "xx"), ("alone", "yy")]
    assert found(collocations(made(spark, rows).repartition(7))) == brute(rows)


def test_parameters(spark):
    rows = prose(3, 200, 10)
    assert found(collocations(made(spark, rows), least=3, subsumed=90, top=25)) == brute(rows, 3, 90, 25)


def test_small_chunks_lose_no_phrase(spark, monkeypatch):
    """Texts over many chunks: phrases across the cuts count once."""
    rows = [(t.replace(".", " "), lang) for t, lang in prose(4, 150, 12)]
    rows = [(" ".join(t for t, _ in rows if t), "en")]
    monkeypatch.setattr(co, "CHUNK", 50)
    batch = pa.record_batch({"lang": [r[1] for r in rows], "text": [r[0] for r in rows]})
    got, want = Counter(), Counter()
    for bits in (None, np.full(1 << 10, 255, np.uint8)):
        for b in co.stripes_of({("en", b"the"): 5, ("en", b"a"): 2}, bits)([batch]):
            for r in b.to_pylist():
                for after, n in zip(r["next"], r["n"]):
                    got[(r["prefix"], *after.split(" "))] += n
    words = Counter()
    for b in co.count_words([batch]):
        for r in b.to_pylist():
            words[r["word"]] += r["n"]
    plain = Counter()
    for piece in re.split("[.,;:!?\n-\r]", rows[0][0].translate(LOWER)):
        w = re.findall(r"[^ \t]+", piece)
        plain.update(w)
        for k in (2, 3):
            want.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    assert got == want and words == plain


def test_a_hot_prefix_is_dealt_out():
    batch = pa.record_batch({"lang": ["en"], "text": [" ".join(f"the w{i}" for i in range(400))]})
    parts = {}
    for b in co.stripes_of({("en", b"the"): 8})([batch]):
        for r in b.to_pylist():
            if r["prefix"] == "the":
                parts[r["part"]] = len(r["next"])
    assert len(parts) == 8 and max(parts.values()) < 250


def test_map_of_pairs_has_the_bits_of_its_pairs(spark):
    pairs = [(f"w{i}", f"é{i % 7}") for i in range(500)]
    bits = co.pair_map(spark.createDataFrame(pairs, "w1 string, w2 string"), 1 << 20)
    names = [w.encode() for p in pairs for w in p]
    found = co.set_in(bits, np.arange(len(names)), names)
    assert found[::2].all() and found[1::2].sum() < 5 and np.unpackbits(bits).sum() <= 500


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(9_000_000_000_001, 9_000_000_000_003, 9_100_000_000_007)], "a long, l long, r long")
    got = row.select(co.score(row.a, row.l, row.r).alias("s")).first().s
    assert got == 1_000_000 * 9_000_000_000_001 ** 2 // (9_000_000_000_003 * 9_100_000_000_007)


def test_ties_repeated_rows_and_empty_tables(spark):
    rows = [("x y. é z. z é", "en")] * 12 + [("p q r", None)] * 10
    assert found(collocations(made(spark, rows))) == brute(rows)
    assert [r[2] for r in brute(rows) if r[0] == "en"] == ["x y", "z é", "é z"]
    assert collocations(made(spark, [])).count() == 0
    assert collocations(made(spark, [(None, None), ("", "en")])).count() == 0
