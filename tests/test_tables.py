"""Small tables: filters, joins, text, cleaning, sources, series, models."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumenframe.functions import dates, text
from lumenframe.operators import (
    aggregates as ag, baskets as bk, cleaning as cl, features as ft, filters as fl, joins as jn, models as md, profile as pf,
    projection as pj, quality as ql, sampling as sp, scaling as sc, sets as st, timeseries as ts)
from lumenframe.sources import files, paged, relational, writers


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (3, "Ab", float("nan"))], "id int, s string, v double")
    assert rows(fl.filter_rows(df, "s", "!=", "a").select("id"), "id") == [(2,), (3,)]
    assert rows(fl.filter_rows(df, "v", "isnull").select("id"), "id") == [(2,), (3,)]
    assert rows(fl.filter_rows(df, "s", "contains", "A").select("id"), "id") == [(1,), (3,)]
    assert rows(fl.filter_rows(df, "id", "isin", "1, 3").select("id"), "id") == [(1,), (3,)]
    with pytest.raises(ValueError):
        fl.filter_rows(df, "s", ">", "a")


def test_join_names_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (None, "m"), (2, "z")], "k int, v string")
    assert sorted(rows(jn.join(a, b, "k")), key=str) == sorted([(1, "x", "y"), (None, "n", "m")], key=str)
    assert jn.join(a, b, "k", null_keys_match=False).count() == 1
    outer = jn.join(a, b, "k", how="outer")
    assert outer.columns == ["k", "v_x", "v_y"] and outer.where("k = 2").first().v_y == "z"


def test_group_keys_and_sums(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1.0)], "g string, v double")
    assert rows(ag.group_by_aggregate(df, ["g"], {"v": ["sum", "median", "nope"]})) == [("a", 0.0, None, None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("o'neil foo-bar",), ("-5",), (None,)], "s string")
    assert [r[0] for r in df.select(text.title(F.col("s"))).collect()] == ["O'Neil Foo-Bar", "-5", None]
    assert df.select(text.zero_fill(F.col("s"), 4)).collect()[1][0] == "-005"
    secret = spark.createDataFrame([("postgres://u:hunter2@h password = 'abc' Bearer abcdefghijklmnopqrst",)], "s string")
    masked = secret.select(text.mask_secrets(F.col("s"))).first()[0]
    assert "hunter2" not in masked and "abc'" not in masked and "abcdefghijklmnopqrst" not in masked
    assert dates.spark_pattern("%d.%m.%Y at %H") == "dd.MM.yyyy 'a''t' HH"


def test_split_and_convert(spark):
    df = spark.createDataFrame([("a|b|c", "1"), ("d", "x")], "s string, n string")
    assert rows(pj.split_column(df, "s", "|").select("s_part_1", "s_part_3"), "s_part_1") == [("a", "c"), ("d", None)]
    assert rows(pj.convert_types(df, {"n": "numeric"}).select("n"), "n") == [(None,), (1.0,)]


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 3.0, "a"), (4, None, "b")], "id int, v double, s string")
    out, log = cl.impute(df, {"v": "interpolate", "s": "mode"}, order_by="id")
    assert rows(out, "id") == [(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "a"), (4, 3.0, "b")]
    assert {r["column"]: r["affected"] for r in log.collect()} == {"v": 2, "s": 1}
    empty = spark.createDataFrame([(None,)], "s string")
    assert rows(cl.impute(empty, {"s": "mode"})[0]) == [("Unknown",)]
    with pytest.raises(ValueError):
        cl.impute(df, {"v": "ffill"})


def test_auto_clean(spark):
    df = spark.createDataFrame([(i, " x ", None if i == 3 else float(i), "same") for i in range(20)] + [(0, " x ", 0.0, "same")],
                               "id int, s string, v double, c string")
    out, log = cl.auto_clean(df)
    assert out.columns == ["id", "v"] and out.count() == 20 and out.where("v is null").isEmpty()
    assert {"s", "c"} <= {r["column"] for r in log.collect()}


def test_health_and_rules(spark):
    df = spark.createDataFrame([("a ", 1.0), ("a ", 1.0), ("b", None)], "s string, v double")
    row = pf.health_score(df).first()
    assert row.missing_cells == 1 and row.duplicated_rows == 1 and row.grade in "ABCD"
    assert rows(pf.padded_text(df)) == [("s", 2)]
    out = {r.rule_type: r.violations for r in ql.evaluate_rules(df, [
        {"column": "v", "rule_type": "not_null"}, {"column": "s", "rule_type": "allowed_values", "params": {"allowed": ["b"]}}]).collect()}
    assert out == {"not_null": 1, "allowed_values": 2}


def test_date_text_is_a_date_column(spark):
    df = spark.createDataFrame([("2024-01-05", "a"), ("2024-02-05", "b")], "signup string, s string")
    roles = {r["column"]: r["role"] for r in pf.profile(df).collect()}
    assert roles == {"signup": "datetime", "s": "categorical"}


def test_bins_and_labels(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    out = sc.bin_column(df, "v", "equal_width", 2).groupBy("v_bin").count()
    assert dict(rows(out)) == {"(-0.01, 5.0]": 6, "(5.0, 10.0]": 5}
    assert sc.bin_feature(spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double"), "v", 4).columns == ["v"]


def test_one_hot_other(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbc"] + [(None,)], "s string")
    out = ft.one_hot(df, ["s"], max_categories=2)
    assert out.columns == ["s", "s_Other", "s_a", "s_b"] and out.agg(F.sum("s_Other")).first()[0] == 2


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(2000)
    a = sp.sample_fraction(df, .1, ["id"])
    assert rows(a, "id") == rows(sp.sample_fraction(df.repartition(7), .1, ["id"]), "id") and 120 < a.count() < 280
    assert sp.sample_n(df, 17, ["id"]).count() == 17
    train, test = md.split(df, ["id"])
    assert train.count() + test.count() == 2000 and 300 < test.count() < 500


def test_dedup_modes(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    assert st.dedup(df).count() == 3 and st.dedup(df, "drop_all").count() == 2


def test_delimited_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(" id ;name;score\n1;Zoë;1.5\n2;Bob;x;extra;more\n3;;2\n4\n".encode("latin1"))
    df = files.load(spark, str(path))
    assert df.columns == ["id", "name", "score"] and rows(df, "id") == [(1, "Zoë", 1.5), (3, None, 2.0), (4, None, None)]
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ValueError):
        files.load(spark, "book.xlsx")


def test_json_documents(spark, tmp_path):
    docs = [{"_id": "1", "customer": "Acme", "metrics": {"sessions": 42, "deep": {"x": {"y": 1}}}, "tags": ["a"]},
            {"_id": "2", "customer": "Beta", "metrics": {"sessions": 7, "deep": {"x": {"y": 2}}}, "tags": []}]
    (tmp_path / "d.json").write_text(json.dumps(docs))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(x) for x in docs))
    df = files.load(spark, str(tmp_path / "d.json"))
    assert "metrics.sessions" in df.columns and "metrics.deep.x" in df.columns
    assert [r["metrics.sessions"] for r in df.orderBy("_id").collect()] == [42, 7]
    raw = spark.read.json(str(tmp_path / "d.jsonl"))
    found = files.find_documents(raw, {"metrics.sessions": {"$gt": 10}}, {"customer": 1})
    assert rows(found) == [("1", "Acme")]
    kinds = {r["field"]: r["type"] for r in files.document_schema(spark, str(tmp_path / "d.jsonl")).collect()}
    assert kinds["customer"] == "string" and kinds["tags"] == "array<string>"


def test_json_path(spark):
    df = spark.createDataFrame([('{"data": {"items": [{"a": 1}, {"a": 2}]}}',), ('{"data": 5}',)], "body string")
    assert sorted(r.item for r in files.json_items(df, "body", "data.items").collect()) == ['{"a":1}', '{"a":2}', '{"value":"5"}']


def test_paged_source_reads_pages_in_tasks(spark, tmp_path):
    for page in (1, 2, 3):
        body = {"data": {"items": [{"id": page * 10 + i, "meta": {"ok": True}} for i in range(2)]}} if page < 3 else {"data": {"items": []}}
        (tmp_path / f"p{page}.json").write_text(json.dumps(body))
    df = paged.read_pages(spark, f"file://{tmp_path}/p{{page}}.json", "id int, meta struct<ok: boolean>", "data.items", max_pages=3)
    assert df.columns == ["id", "meta.ok"] and sorted(r.id for r in df.collect()) == [10, 11, 20, 21]


def test_page_addresses():
    assert paged.page_url({"url": "http://h/x", "pagination": "page"}, 3) == "http://h/x?page=3&limit=100"
    assert paged.page_url({"url": "http://h/x?a=1", "pagination": "offset", "page_size": "10"}, 3) == "http://h/x?a=1&offset=20&limit=10"


def test_database_addresses_and_listing(spark):
    assert relational.jdbc_url("postgresql", "h", 5432, "db") == "jdbc:postgresql://h:5432/db"
    assert relational.jdbc_options("jdbc:sqlite:/x.db")["driver"] == "org.sqlite.JDBC"
    with pytest.raises(ValueError):
        relational.read_jdbc(spark, "jdbc:sqlite:/x.db")
    listed = relational.session_schema(spark, {"t": spark.range(3)}, count_rows=True)
    assert rows(listed) == [("t", "id", "bigint", False, 1, 3)]


def test_exports_and_batches(spark, tmp_path):
    df = spark.range(25)
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 25
    writers.write_json_records(df, str(tmp_path / "j"), 10, "id")
    assert [r.id for r in spark.read.json(str(tmp_path / "j")).orderBy("id").collect()] == list(range(10))
    writers.write_parquet(df.withColumn("k", F.col("id") % 2), str(tmp_path / "p"), partition_by=["k"])
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 1").count() == 12
    assert [len(b) for b in writers.batches(df, 10)] == [10, 10, 5]


def test_resample_and_forecasts(spark):
    df = spark.createDataFrame([(f"2024-{m:02d}-15", float(m)) for m in range(1, 13) if m != 4], "d string, v double")
    series = ts.resample(df, "d", "v")
    assert [r.value for r in series.orderBy("period").collect()][:5] == [1, 2, 3, 0, 5]
    out = ts.forecast(series, 3, algorithm="moving_average").orderBy("step").collect()
    assert [str(r.period.date()) for r in out] == ["2025-01-01", "2025-02-01", "2025-03-01"]
    assert out[0].forecast == pytest.approx(10.5) and out[0].lower_95 <= out[0].lower_80 <= out[0].forecast <= out[0].upper_80
    assert ts.detect_columns(df.withColumnRenamed("d", "sale_date")) == ("sale_date", "v")
    with pytest.raises(ValueError):
        ts.resample(df, "d", "v", "X")


def test_holt_winters_follows_a_season(spark):
    df = spark.createDataFrame([(i, 100.0 + 2 * i + (20 if i % 12 == 5 else 0)) for i in range(48)], "i int, v double").select(
        F.add_months(F.lit("2020-01-01").cast("date"), F.col("i")).cast("timestamp_ntz").alias("period"), F.col("v").alias("value"))
    out = ts.forecast(df, 12, algorithm="holt_winters").orderBy("step").collect()
    values = [r.forecast for r in out]
    assert max(range(12), key=lambda i: values[i]) == 5 and values[0] == pytest.approx(196, rel=.1)


def test_model_round_trip(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("s"),
                                 F.when(F.col("id") % 20 > 9, "yes").otherwise("no").alias("y"))
    run = md.train(df, "y", "decision_tree", ["id"], ["x", "s"])
    assert run.metrics["accuracy"] == 1.0 and run.metrics["auc"] == 1.0 and run.classes == ["no", "yes"]
    assert md.importances(run).first().feature == "x"
    scored = md.score(run, df).where("id in (0, 15)").orderBy("id").collect()
    assert [r.predicted_class for r in scored] == ["no", "yes"]
    card = md.model_card(run, "1")
    assert md.compare_cards(card, ["1"]).where("metric = 'accuracy'").first()["1"] == 1.0
    with pytest.raises(ValueError):
        md.train(df, "y", "ridge", ["id"], ["x"])


def test_automl_drops_leaks(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                 (F.col("id") % 2).cast("double").alias("leak"), F.when(F.col("id") % 2 == 1, "Yes").otherwise("No").alias("y"),
                                 F.lit(1).alias("constant"))
    out = md.automl(df, "y", ["id"], ["logistic", "decision_tree"])
    assert [r.feature for r in out.leaks.where("leaks").collect()] == ["leak"]
    assert "leak" not in out.champion.features and out.leaderboard.where("champion").count() == 1


def test_task_types(spark):
    df = spark.range(60).select((F.col("id") * 1.5).alias("r"), (F.col("id") % 12).alias("few"), F.when(F.col("id") > 5, "a").otherwise("b").alias("two"))
    assert [md.task_type(df, c) for c in ("r", "few", "two")] == ["regression", "multiclass", "binary"]
    with pytest.raises(ValueError):
        md.task_type(df, "gone")


def test_basket_rules_agree(spark):
    df = spark.createDataFrame([(t, i) for t, items in enumerate(["ab", "abc", "ab", "c", "bc", "a"]) for i in items], "t int, i string")
    pairs = {(r.antecedent, r.consequent): r for r in bk.pair_rules(df, "t", "i", .3, .1, 0.0, None).collect()}
    assert pairs[("a", "b")].support == pytest.approx(3 / 6) and pairs[("a", "b")].confidence == pytest.approx(3 / 4)
    assert pairs[("a", "b")].lift == pytest.approx(.75 / (4 / 6))
    grown = {(r.antecedent, r.consequent): r.lift for r in bk.association_rules(df, "t", "i", .3, .1, 0.0, None).collect()}
    for key, r in pairs.items():
        assert grown[key] == pytest.approx(r.lift)


def test_encoding_is_read_from_all_lines(spark, tmp_path):
    """A byte that is not UTF-8 far down the file decides as well as one at the top."""
    from lumenframe.sources import files

    (tmp_path / "late.csv").write_bytes(b"id,name\n" + b"1,plain\n" * 1000 + "2,caf\u00e9\n".encode("latin-1"))
    (tmp_path / "plain.csv").write_text("id,name\n" + "1,caf\u00e9\n" * 3, encoding="utf-8")
    assert files.load(spark, str(tmp_path / "late.csv")).where("name = 'caf\u00e9'").count() == 1
    assert files.load(spark, str(tmp_path / "plain.csv")).where("name = 'caf\u00e9'").count() == 3


def test_all_pages_are_read(spark, tmp_path):
    for page in range(1, 16):
        (tmp_path / f"p{page}.json").write_text(json.dumps([{"id": page}] if page < 8 else []))
    df = paged.read_pages(spark, f"file://{tmp_path}/p{{page}}.json", "id int")
    assert sorted(r.id for r in df.collect()) == list(range(1, 8))


def test_fields_of_late_documents(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(['{"a": 1}'] * 50 + ['{"a": 1.5, "late": "x"}']))
    assert rows(files.document_schema(spark, str(tmp_path / "d.jsonl")), "field") == [("a", "double"), ("late", "string")]


def test_dates_are_decided_on_all_values(spark):
    values = [("2024-01-02", f"2024/03/{i % 28 + 1:02d}") for i in range(200)] + [("not a day", "2024-04-01"), (None, None)]
    df = spark.createDataFrame(values, "sale_date string, plain string").coalesce(1)
    assert {r["column"]: r["role"] for r in pf.profile(df).collect()} == {"sale_date": "categorical", "plain": "datetime"}
    assert pf.feature_categories(df)["datetime"] == ["plain"]
    assert ts.detect_columns(df)[0] is None


def test_resample_shuffles_no_empty_period(spark):
    """A regular row comes from the found period before it: one sort of found periods, no join with a spine of all periods."""
    df = spark.createDataFrame([(1, "2020-01-01", 2.0), (1, "2020-03-05", None), (1, "2020-02-29", 4.0), (2, "2021-12-31", 1.0), (None, "2021-01-01", 9.0), (3, None, 1.0)], "k int, d string, v double")
    daily = ts.resample(df, "d", "v", "D", "mean", ["k"])
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange")
    got = [(r.k, str(r.period.date()), r.value) for r in daily.orderBy("k", "period").collect()]
    assert len(got) == 66 and got[0] == (1, "2020-01-01", 2.0) and got[59] == (1, "2020-02-29", 4.0) and got[64] == (1, "2020-03-05", None) and got[65] == (2, "2021-12-31", 1.0)
    assert sum(v is not None for _, _, v in got) == 3
    for freq, periods in (("W", 11), ("M", 4), ("Q", 2), ("Y", 2)):
        assert ts.resample(df, "d", "v", freq, "sum", ["k"]).where("value is not null").count() == periods, freq


def test_baskets_are_written_once(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    pairs, total, _ = bk._frequent(t, "l_orderkey", "l_partkey", 0.0)
    assert "Relation" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert total == t.select("l_orderkey").distinct().count()


def test_auto_clean_folds_repeated_rows_once(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_returnflag", "l_quantity")
    clean, _ = cl.auto_clean(t)
    assert "Relation" not in clean._jdf.queryExecution().optimizedPlan().toString()
    assert clean.count() == t.distinct().count()
