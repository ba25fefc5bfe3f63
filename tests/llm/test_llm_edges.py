"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm.chat import format_conversations, read_back
from lumenframe.llm.licences import scan
from lumenframe.llm.lm_scores import lm_scores
from lumenframe.llm.mixing import mix
from lumenframe.llm.near_text import near_text, one_of_each
from lumenframe.llm.near_vectors import near_vectors
from lumenframe.llm.neighbours import nearest
from lumenframe.llm.packing import pack
from lumenframe.llm.quality import quality_scores
from lumenframe.llm.token_counts import token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, block string, key string, doc string"
PROSE = " ".join(f"word{i} and thing{i % 7}" for i in range(40))
LONG = " ".join(f"t{i}" for i in range(60_000))
BIG = (1 << 60) + 1


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None, 1.0, "x", "b", "k", "d") for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (None, PROSE, None, None), (3, None, "de", "b"), (4, "", "de", "b"),
        (5, " \n\t ", "fr", None), (6, "one two", "en", "a"), (7, LONG, "en", "a"), (BIG, "Released under the MIT License.", "en", "b"), (9, "<|endoftext|> 'tis é 日本 🎉", "es", "b")]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, None, 0), (6, 0, 0), (3, 0, 1), (None, 1, None), (7, 1, 0)], "doc_id long, quality int, toxic int")


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_token_counts(spark, odd):
    got = by_id(token_counts(odd, BPE))
    assert got[3][0].n_tokens == got[4][0].n_tokens == 0 and got[3][0].n_bytes == 0
    assert len(got[2]) == 2 and got[2][0] == got[2][1] and got[None][0].n_tokens == got[1][0].n_tokens
    assert got[7][0].over_limit and BIG in got
    assert token_counts(docs(spark, []), BPE).count() == 0


def test_packing(spark, odd):
    got = pack(odd, BPE).withColumn("n", F.octet_length("ids")).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 1 and sum(r.length for r in got if r.doc_id == BIG) > 1
    assert all(r.n == 4 * r.length for r in got) and any(r.doc_id is None for r in got)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert pack(docs(spark, []), BPE).count() == 0


def test_quality(spark, odd, labels):
    got = by_id(quality_scores(odd, labels))
    assert sum(map(len, got.values())) == odd.count() and all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert got[3][0].score == got[4][0].score and got[1][0].score == got[2][0].score == got[None][0].score
    assert {r.score for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs(spark, []), labels).count() == 0


def test_near_text(spark, odd):
    got = by_id(near_text(odd))
    assert got[1][0].class_id == got[2][0].class_id == got[None][0].class_id == 1 and got[1][0].n_links == 3
    assert got[3][0].class_id == 3 and got[4][0].class_id == 4 and got[5][0].class_id == 5 and all(got[i][0].n_links == 0 for i in (3, 4, 5, 6))
    assert got[1][0].kept and not got[2][0].kept and got[BIG][0].kept
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 9, BIG]
    assert near_text(docs(spark, [])).count() == 0
    alone = one_of_each(docs(spark, [(2, PROSE, "en", "a")] * 3 + [(None, None, None, None)]))
    assert sorted((str(r.doc_id) for r in alone.collect())) == ["2", "None"]


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(i, PROSE, "en", "a", i) for i in (4, 2)] + [(5, "other words stand here all day", "en", "a", 7)]
    names = {"__md5": "x", "md5": "y", "kept_id": "z", "kept_md5": "w", "doc_column_0": "v", "doc_column_4": "u"}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").withColumns({c: F.lit(v) for c, v in names.items()})
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.n, *[r[c] for c in names]) for r in kept.collect()) == [(2, 2, *names.values()), (5, 7, *names.values())]


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["whole", "last", "times", "rest", "hash", "range", "at_mix_lang", "up_mix_lang", "c_at_mix_lang", "mix_place", "doc_column_0", "given", "Tokens"]
    frame = spark.createDataFrame([(i, "a b c", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    frame = frame.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for epochs, budget in ((1, 0.5), (2, 1.5)):
        out = mix(frame, {"lang": "lang"}, [{}], budget, epochs)
        assert out.columns == [*frame.columns, "mix_lang", "mix_tokens", "mix_epoch"]
        got = out.collect()
        assert len(got) == 40 * budget and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    replaced = mix(frame.withColumn("mix_epoch", F.lit("x")), {"lang": "lang"}, [{}], 1.0)
    assert replaced.columns == [*frame.columns, "mix_lang", "mix_tokens", "mix_epoch"] and replaced.first().mix_epoch == 1


def test_quality_learns_one_text_of_an_id(spark, odd, labels):
    assert quality_scores(odd.withColumn("doc_id", F.col("doc_id").cast("string")), labels.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == odd.count()


def test_mixing(spark, odd):
    levels = {"lang": "lang", "source": "source"}
    whole = mix(odd, levels, [{}, {}], 1.0)
    assert whole.count() == odd.count() and set(odd.columns) <= set(whole.columns)
    half = mix(odd, levels, [{"en": 1}, {}], 0.1)
    assert half.agg(F.sum("mix_tokens")).first()[0] <= 0.1 * whole.agg(F.sum("mix_tokens")).first()[0]
    assert mix(docs(spark, []), levels, [{}, {}], 0.5).count() == 0
    assert mix(docs(spark, [(1, None, "en", "a"), (2, "", None, None)]), levels, [{}, {}], 0.5).count() == 2


def test_licences(spark, odd):
    got = scan(odd).collect()
    assert [(r.doc_id, r.license, r.containment, r.first_word) for r in got] == [(BIG, "mit line", 1.0, 0)]
    assert scan(docs(spark, [])).count() == 0 and scan(odd, {}).count() == 0
    far = docs(spark, [(1, "alpha beta " * 5000 + "Licensed under the Apache License, Version 2.0." + " gamma delta" * 3000, "en", "a"), (None, "Released under the MIT License.", "en", "a")])
    assert {(r.doc_id, r.license, r.first_word) for r in scan(far).collect()} == {(1, "apache-2.0 line", 10000), (None, "mit line", 0)}


def test_lm_scores(spark, odd):
    got = by_id(lm_scores(odd, BPE))
    assert sum(map(len, got.values())) == odd.count()
    assert got[3][0].n_tokens == got[4][0].n_tokens == got[5][0].n_tokens == 1 and got[3][0].score == got[4][0].score < 0
    assert got[7][0].n_tokens == 60_001 and got[1][0].score == pytest.approx(got[2][0].score, rel=1e-6) and got[6][0].n_tokens == 3
    assert lm_scores(docs(spark, []), BPE).count() == 0


VECTORS = "vec_id long, embedding array<float>, key string, v string, cell long, rank int, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "k", "v", 1, 1, 0) for i, v in rows], VECTORS)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = vectors(spark, [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.99, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [100.0, 0.0])])
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    assert len(near_vectors(table).collect()) == 12
    assert got[0].n_links == 3 and got[9].component_id == 0 and got[2].n_links == 0 and got[8].component_id == 8 and got[3].kept and got[4].n_links == 0
    near = nearest(table).collect()
    mine = sorted((r["rank"], r.vec_id, r.score) for r in near if r.query_id == 0)
    assert [v for _, v, _ in mine] == [100, 100, 2, 9] and mine[0][2] == 0 and mine[2][2] == 2 ** 0.5
    assert nearest(vectors(spark, [])).count() == 0 and near_vectors(vectors(spark, [])).count() == 0
    assert nearest(vectors(spark, [(0, [1.0])])).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a\\b [INST]"), (1, 1, "assistant", "</s>\\"), (1, 1, "assistant", "</s>\\"), (2, None, None, None), (None, 0, "assistant", "x"), (3, 0, "us[/INST]er\n", ""), (3, 1, "assistant", "é" * 200_000)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = by_id(read_back(format_conversations(table)), "conv_id")
    assert got[1][0].n_turns == 3 and got[1][0].loss_chars == 10 and got[2][0].n_turns == 1 and got[2][0].loss_chars == 0
    assert got[None][0].loss_chars == 1 and got[3][0].loss_chars == 200_000 and got[3][0].n_turns == 2
    assert read_back(format_conversations(table.limit(0))).count() == 0


def test_pipeline_stages(spark, odd, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    clash = {c: F.lit(c) for c in ("whole", "last", "times", "at_mix_lang", "__md5", "block", "key", "doc")}
    frame = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, folder)
        if name != "packing":
            assert out.columns == frame.columns, name
        out.write.parquet(f"{folder}/{name}.parquet")
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0), folder).count() == 0, name
