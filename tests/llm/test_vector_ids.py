"""Ids that occur with several vectors."""

from lumenframe.llm.neighbours import nearest


def test_an_id_with_two_vectors_is_two_candidates(spark):
    rows = [(100, [1.0, 0.0]), (5, [1.0, 0.1]), (5, [1.0, 0.2]), (7, [1.0, 0.2])]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in found] == [(100, 5, 0.1), (100, 5, 0.2), (100, 7, 0.2)]


def test_own_vectors_take_no_place(spark):
    rows = [(100, [1.0, i / 100]) for i in range(30)] + [(i, [2.0, float(i)]) for i in range(1, 13)]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 11)) and 100 not in {r.vec_id for r in found}
