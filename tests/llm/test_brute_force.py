"""Registered queries without SQL against plain, slow versions of what they compute."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm import quality as ql
from lumenframe.llm.queries import QUERIES
from lumenframe.llm.template import TemplateError, compile_template

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def documents(folder):
    return duckdb.sql(f"select doc_id, coalesce(text, '') as text, lang, source from '{folder}/documents.parquet'").fetchall()


def test_op2_distances_are_exact_and_recall_holds(spark):
    rows = {i: np.array(v, np.float64) for i, v in duckdb.sql(f"select vec_id, embedding from '{LARGE}/embeddings.parquet'").fetchall()}
    got = defaultdict(list)
    for r in QUERIES["op2_neighbours"](spark, LARGE).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        apart = {i: math.sqrt(((v - rows[q]) ** 2).sum()) for i, v in rows.items() if i != q}
        true = sorted(apart.items(), key=lambda x: (x[1], x[0]))[:10]
        assert [rank for rank, _, _ in found] == list(range(1, 11))
        assert all(abs(apart[i] - score) <= 1e-9 * score for _, i, score in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for i, _ in true} & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_op4_counts_are_the_library_s(spark, library, folder):
    want = {d: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t, _, _ in documents(folder)}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op4_token_counts"](spark, folder).collect()}
    assert got == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in QUERIES["op4_token_counts"](spark, SMALL).collect())


def check_pieces(pieces, texts, library):
    """Every id of every text in one piece, sequences without gaps, only powers of two below 1024."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_op7_pieces_hold_every_id_once(spark, library):
    check_pieces(QUERIES["op7_packing"](spark, SMALL).collect(), {d: t for d, t, _, _ in documents(SMALL)}, library)


def plain_score(model, text):
    """The classifier on one text, passage by passage and number by number."""
    raw = text.encode()
    step = max(ql.PASSAGE, -(-len(raw) // ql.PASSAGES))
    parts = [raw[i:i + step] for i in range(0, len(raw), step)] or [b""]
    gates, states = [], []
    for p in parts:
        x = np.zeros(ql.FEATURES)
        n = max(len(p), 1)
        for i, b in enumerate(p):
            x[int(ql.KIND[b])] += 1 / n
            if i + 1 < len(p):
                x[ql.WIDTH + ql.WIDTH * int(ql.KIND[b]) + int(ql.KIND[p[i + 1]])] += 1 / n
        x[-2], x[-1] = (len(zlib.compress(p, 1)) - 8 if p else 0) / n, math.log1p(len(p)) / 10
        z = (x - model["mean"]) / model["scale"]
        h = np.array([math.tanh(v) for v in z @ model["w"] + model["b"]])
        gate = np.tanh(h @ model["v"]) * (1 / (1 + np.exp(-(h @ model["u"]))))
        gates.append(math.exp(gate @ model["a"]))
        states.append(h)
    bag = sum(g * h for g, h in zip(gates, states)) / sum(gates)
    return 1 / (1 + math.exp(-float((bag @ model["c"] + model["d"])[0])))


def test_op6_scores_are_those_of_a_plain_forward_pass(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = ql.fit(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, MIDDLE).collect()}
    texts = {d: t for d, t, _, _ in documents(MIDDLE)}
    assert set(got) == set(texts)
    for doc, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    for doc in sorted(texts)[::25]:
        assert abs(got[doc].score - plain_score(model, texts[doc])) < 1e-4, doc
    known = duckdb.sql(f"select doc_id, quality from '{MIDDLE}/labels.parquet' where quality is not null").fetchall()
    held = [(got[d].score, q) for d, q in known if got[d].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert good and bad and sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def shingles(text):
    words = text.lower().split()
    if not words:
        return None
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def near_classes(texts):
    """(links, smallest id that links lead to) of each document, over all pairs."""
    sets = {d: shingles(t) for d, t in texts.items()}
    sets = {d: s for d, s in sets.items() if s is not None}
    links, parent = defaultdict(int), {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if min(len(sets[a]), len(sets[b])) >= 0.79 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    high, low = max(root(a), root(b)), min(root(a), root(b))
                    parent[high] = low
    return links, {d: root(d) for d in texts}


def test_op9_links_and_classes_are_those_of_all_pairs(spark):
    links, classes = near_classes({d: t for d, t, _, _ in documents(MIDDLE)})
    got = QUERIES["op9_near_text"](spark, MIDDLE).collect()
    assert len(got) == len(classes) and sum(links.values()) > 0
    for r in got:
        assert (r.n_links, r.class_id, r.kept) == (links[r.doc_id], classes[r.doc_id], classes[r.doc_id] == r.doc_id)


def test_op10_digests_are_those_of_the_table(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, coalesce(text, '') from '{MIDDLE}/conversations.parquet' order by 1, 2").fetchall()
    odd = "</s>[INST] ok [/INST]"
    turns = defaultdict(list, {-1: [("user", odd), ("assistant", odd)]})
    for conv, _, role, text in rows:
        turns[conv].append((role, text))
    got = {r.conv_id: r for r in QUERIES["op10_chat"](spark, MIDDLE).collect()}
    assert set(got) == set(turns)
    for conv, parts in turns.items():
        learned = "".join(t for role, t in parts if role == "assistant")
        assert got[conv].n_turns == len(parts) and got[conv].loss_chars == len(learned)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parts).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert got[conv].formatted_chars >= sum(len(r) + len(t) for r, t in parts)


@pytest.mark.parametrize("source,want", [
    ("{{ 1 + 2 }}{{ 'a' ~ 1 }}", "3a1"), ("{{ ''.__class__ }}{{ messages.__class__ }}|", "|"),
    ("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}", "1user,2assistant"),
    ("{% if messages[0].role == 'user' and true %}yes{% else %}no{% endif %}", "yes"),
    ("{% set x = 'k' %}{{ x }}{# gone #}", "k"),
    ("a  {%- if true -%}  b  {%- endif -%}  c", "abc")])
def test_templates(source, want):
    render = compile_template(source)
    assert "".join(p for p, _ in render(messages=[{"role": "user", "text": "q"}, {"role": "assistant", "text": "r"}])) == want


@pytest.mark.parametrize("source", ["{% for %}", "{% if true %}", "{{ 1 * }}", "{% endfor %}"])
def test_templates_that_are_refused(source):
    with pytest.raises(TemplateError):
        "".join(p for p, _ in compile_template(source)(messages=[]))


def test_generation_marks_are_the_loss_mask():
    parts = list(compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")(x="y"))
    assert "".join(p for p, learned in parts if learned) == "by" and "".join(p for p, learned in parts if not learned) == "ac"


def test_pipeline_stage_by_stage(spark, tmp_path, library):
    frame, kept = spark.read.parquet(f"{MIDDLE}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, MIDDLE).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            kept[name] = {r.doc_id: r.text or "" for r in frame.collect()}
    scores = {r.doc_id: r.score for r in QUERIES["op6_quality"](spark, MIDDLE).collect()}
    assert set(kept["quality"]) == {d for d, s in scores.items() if s >= 0.5}
    _, classes = near_classes(kept["quality"])
    assert set(kept["near_duplicates"]) == set(classes.values())
    assert set(kept["mixing"]) < set(kept["near_duplicates"]) and all(kept["mixing"][d] == t for d, t in kept["near_duplicates"].items() if d in kept["mixing"])
    size = {d: len([w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]) for d, t in kept["near_duplicates"].items()}
    used = sum(size[d] for d in kept["mixing"])
    assert 0.85 * sum(size.values()) <= used <= 0.9 * sum(size.values())
    check_pieces(frame.collect(), kept["mixing"], library)
