"""Models, metrics, clusters, neighbours and association rules."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumenframe.operators import baskets as bk, clusters as cl, isolation as iso, minibatch as mb, models as md, neighbours as nb, ward as wd
from lumenframe.operators.dbscan import dbscan
from lumenframe.operators.svr import LinearSVR
from lumenframe.plans.registry import query, r, rounded, show, table


def parts(spark, d):
    """Parts with a price to predict, a two-way and a three-way class that depend on the columns."""
    t = table(spark, d, "part")
    return t.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice",
                    F.when(F.col("p_size") + F.length("p_name") > 33, "yes").otherwise("no").alias("big"),
                    F.when(F.col("p_size") < 17, "low").when(F.col("p_size") < 34, "mid").otherwise("top").alias("tier"))


@query("Q1_task_types", """
select 'p_retailprice' as target, 'regression' as task from part group by all having count(distinct p_retailprice) > 12 union all
select 'big', 'binary' union all select 'tier', 'multiclass'""")
def task_types(spark, d):
    t = parts(spark, d)
    return spark.createDataFrame([(c, md.task_type(t, c)) for c in ("p_retailprice", "big", "tier")], "target string, task string")


@query("Q2_split_stratified", """
with c as (select o_orderstatus, count(*) as n from orders group by 1)
select o_orderstatus, cast(n - round(n * 0.2) as bigint) as train_rows, cast(round(n * 0.2) as bigint) as test_rows from c""")
def split(spark, d):
    a, b = md.split_stratified(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"])
    a = a.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("train_rows"))
    return a.join(b.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("test_rows")), "o_orderstatus")


def trained(spark, d, target, model, features=("p_brand", "p_type", "p_size")):
    return md.train(parts(spark, d), target, model, ["p_partkey"], list(features))


@query("Q3_Q6_regression_board")
def regression_board(spark, d):
    names = ["linear", "ridge", "lasso", "elastic_net", "decision_tree", "random_forest", "xgboost", "linear_svr"]
    t = parts(spark, d).withColumn("y", F.col("p_size") * 10 + F.length("p_brand") + F.col("p_partkey") % 7)
    board, _ = md.leaderboard(t, "y", ["p_partkey"], names, ["p_brand", "p_type", "p_size"])
    return board.drop("seconds")


@query("Q4_Q10_classification_board")
def classification_board(spark, d):
    names = ["logistic", "decision_tree", "random_forest", "gradient_boosting", "naive_bayes", "linear_svc"]
    board, _ = md.leaderboard(parts(spark, d), "big", ["p_partkey"], names, ["p_brand", "p_type", "p_size"])
    return board.drop("seconds")


@query("Q10_linear_svr", """
select cast(count(*) as bigint) as n, 0.0::double as quantity_slope, 0.0::double as discount_slope, 0.0::double as intercept_slope, true as below_ridge from lineitem""")
def linear_svr(spark, d):
    """The objective's derivatives at the solution, taken anew from all rows; each per row, and below plain ridge regression's objective."""
    t = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("label"), "l_quantity", (F.col("l_discount") * 100).alias("discount"))
    data = cl.VectorAssembler(inputCols=["l_quantity", "discount"], outputCol="features").transform(t)
    model = LinearSVR(cost=0.5, epsilon=2.0).fit(data)
    (a, b), e = (float(v) for v in model.coefficients), 2.0
    q, s = F.col("l_quantity"), F.col("discount")

    def over(x, y, z):
        residual = F.col("label") - (q * x + s * y + z)
        return F.signum(residual) * F.greatest(F.abs(residual) - e, F.lit(0.0))

    out, n = over(a, b, float(model.intercept)), F.count(F.lit(1))
    ridge = md.LinearRegression(regParam=1.0 / t.count(), standardization=False).fit(data)
    other = over(*(float(v) for v in ridge.coefficients), float(ridge.intercept))
    sums = t.agg(n.alias("n"), ((F.lit(a) - F.sum(out * q)) / n).alias("quantity_slope"), ((F.lit(b) - F.sum(out * s)) / n).alias("discount_slope"),
                 (F.sum(out) / n).alias("intercept_slope"), (F.sum(out * out) < F.sum(other * other)).alias("below_ridge"))
    return sums.select("n", *[F.abs(F.round(c, 6)).alias(c) for c in sums.columns[1:4]], "below_ridge")


@query("Q8_multiclass_scores")
def multiclass(spark, d):
    run = trained(spark, d, "tier", "logistic")
    return md.score(run, parts(spark, d)).select("p_partkey", "tier", "predicted_class", F.to_json("probabilities").alias("probabilities"))


@query("Q12_multilabel")
def multilabel(spark, d):
    t = parts(spark, d).select("p_partkey", "p_size", "p_type", (F.col("big") == "yes").cast("int").alias("a"),
                               (F.col("tier") == "low").cast("int").alias("b"))
    return md.multilabel(t, ["a", "b"], ["p_partkey"], "decision_tree")


@query("Q17_importances")
def importances(spark, d):
    return md.importances(trained(spark, d, "big", "random_forest"))


@query("Q18_permutation_importance")
def permutation(spark, d):
    run = trained(spark, d, "tier", "decision_tree")
    held = md.split(parts(spark, d), ["p_partkey"])[1]  # the rows that training left out
    return md.permutation_importance(run, held, ["p_partkey"])


@query("Q19_local_drivers")
def drivers(spark, d):
    run = trained(spark, d, "big", "decision_tree")
    return md.local_drivers(run, parts(spark, d), 3).select("p_partkey", "prediction", F.to_json("drivers").alias("drivers"))


@query("Q20_scenarios")
def scenarios(spark, d):
    run = trained(spark, d, "p_retailprice", "linear")
    return md.score(run, parts(spark, d)).select("p_partkey", "prediction", "low", "high")


@query("Q22_tuning")
def tuning(spark, d):
    board, _ = md.tune(parts(spark, d).drop("big"), "tier", "decision_tree", ["p_partkey"], {"maxDepth": [2, 4, 6], "minInstancesPerNode": [1, 5]})
    return board


@query("Q21_Q23_automl")
def automl(spark, d):
    t = parts(spark, d).withColumn("leak", (F.col("big") == "yes").cast("double"))
    out = md.automl(t.drop("tier"), "big", ["p_partkey"])
    leaks = out.leaks.where("leaks").select(F.lit("leak").alias("kind"), F.col("feature").alias("name"), F.lit(None).cast("double").alias("value"))
    board = out.leaderboard.select(F.lit("model").alias("kind"), F.col("model").alias("name"), F.col("score").alias("value"))
    return leaks.union(board).union(out.importances.select(F.lit("importance").alias("kind"), "feature", "importance"))


@query("Q32_model_cards")
def cards(spark, d):
    a = md.model_card(trained(spark, d, "tier", "decision_tree"), "1")
    b = md.model_card(trained(spark, d, "tier", "naive_bayes"), "2")
    return md.compare_cards(a.unionByName(b), ["1", "2"])


# ---- metrics on fixed predictions -----------------------------------------------------------------

LINE = "(select l_extendedprice as y, l_quantity * 1500 as p from lineitem)"


@query("Q13_regression_metrics", f"""
select cast(count(*) as bigint) as n, {r('1 - avg(pow(y - p, 2)) / var_pop(y)')} as r2, {r('avg(abs(y - p))', 2)} as mae, {r('sqrt(avg(pow(y - p, 2)))', 2)} as rmse,
  {r('100 * avg(abs((y - p) / y)) filter (where y <> 0)')} as mape_pct from {LINE}""")
def regression_metrics(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    out = md.regression_metrics(t)
    return out.select("n", rounded("r2").alias("r2"), rounded("mae", 2).alias("mae"), rounded("rmse", 2).alias("rmse"), rounded("mape_pct").alias("mape_pct"))


PRED = """(select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y, case when l_quantity < 18 then 0 when l_quantity < 35 then 1 else 2 end as p from lineitem)"""


def flags(spark, d):
    q, f = F.col("l_quantity"), F.col("l_returnflag")
    return table(spark, d, "lineitem").select(F.when(f == "A", 0.0).when(f == "N", 1.0).otherwise(2.0).alias("label"),
                                              F.when(q < 18, 0.0).when(q < 35, 1.0).otherwise(2.0).alias("prediction"))


@query("Q14_classification_metrics", f"""
with c as (select k as c, (select count(*) from {PRED} where y = k) as s, (select count(*) from {PRED} where p = k) as g, (select count(*) from {PRED} where y = k and p = k) as tp
  from (select unnest([0, 1, 2]) as k)), m as (select s, tp, tp * 1.0 / g as pr, tp * 1.0 / s as re from c)
select cast(sum(s) as bigint) as n, {r('sum(tp) * 1.0 / sum(s)', 6)} as accuracy, {r('sum(pr * s) / sum(s)', 6)} as "precision", {r('sum(re * s) / sum(s)', 6)} as recall,
  {r('sum(2 * pr * re / (pr + re) * s) / sum(s)', 6)} as f1 from m""")
def classification_metrics(spark, d):
    return show(md.classification_metrics(flags(spark, d)), 6)


@query("Q14_auc", f"""
with k as (select (l_returnflag = 'R')::int as y, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rk from lineitem)
select {r('(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * 1.0 * sum(1 - y))', 6)} as auc from k""")
def auc(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), "l_quantity")
    return show(md.auc(t, "l_quantity"), 6)


@query("Q15_confusion", f"select cast(y as double) as label, cast(p as double) as prediction, cast(count(*) as bigint) as n from {PRED} group by 1, 2")
def confusion(spark, d):
    return md.confusion(flags(spark, d))


@query("Q15_roc_and_precision_curves", f"""
with s as (select l_quantity as score, sum((l_returnflag = 'R')::int) as pos, sum((l_returnflag <> 'R')::int) as neg from lineitem group by 1),
c as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, sum(pos) over () as p, sum(neg) over () as q from s)
select score, {r('fp / q', 6)} as fpr, {r('tp / p', 6)} as tpr, {r('tp / (tp + fp)', 6)} as "precision" from c""")
def roc(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), "l_quantity")
    return show(md.curves(t, "l_quantity"), 6)


@query("Q16_residuals", f"select l_orderkey, l_linenumber, {r('l_extendedprice - l_quantity * 1500', 2)} as residual from lineitem")
def residuals(spark, d):
    t = table(spark, d, "lineitem").withColumns({"label": F.col("l_extendedprice"), "prediction": F.col("l_quantity") * 1500})
    return show(md.residuals(t).select("l_orderkey", "l_linenumber", "residual"), 2)


# ---- clusters ---------------------------------------------------------------------------------------

def clustered(algorithm, **settings):
    def run(spark, d):
        out = cl.cluster(table(spark, d, "part"), ["p_size", "p_retailprice"], 3, algorithm, **settings)
        return out.rows.select("p_partkey", "cluster", "pca_1", "pca_2")
    return run


for _name, _algorithm in (("Q24_kmeans", "kmeans"), ("Q25_gaussian_mixture", "gmm"), ("Q26_hierarchical", "hierarchical"), ("Q26_bisecting", "bisecting"), ("Q24_minibatch_kmeans", "minibatch_kmeans")):
    query(_name)(clustered(_algorithm))

@query("Q24_minibatch_cost", """
select cast(count(*) as bigint) as n, 6 as clusters, true as nearest, true as near_full_cost from lineitem""")
def minibatch_cost(spark, d):
    """Mini-batch centres over all rows: every row with its nearest centre, cost at most 1.15 of full k-means."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 500).alias("discount"))
    key, columns = ["l_orderkey", "l_linenumber"], ["l_quantity", "discount"]
    means = mb.minibatch_centres(t, key, columns, 6).means
    rows = mb.minibatch_kmeans(t, key, columns, 6)
    least = F.least(*[sum(((F.col(c) - F.lit(float(m[j]))) * (F.col(c) - F.lit(float(m[j]))) for j, c in enumerate(columns)), F.lit(0.0)) for m in means])
    full = cl.KMeans(k=6, seed=42, initSteps=5).fit(cl.VectorAssembler(inputCols=columns, outputCol="features").transform(t)).summary.trainingCost
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").cast("int").alias("clusters"),
                    F.bool_and(F.abs(F.col("distance") - least) < 1e-6).alias("nearest"), (F.sum("distance") <= 1.15 * full).alias("near_full_cost"))


@query("Q26_ward_spread", f"""
select cast(count(*) as bigint) as n, {r('(var_pop(l_quantity) + var_pop(l_discount * 500) + var_pop(l_tax * 500)) * count(*)', 1)} as spread, true as rising from lineitem""")
def ward_spread(spark, d):
    """Sums of squares inside the leaves and the costs of all merges add up to the table's spread."""
    t = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 500).alias("discount"), (F.col("l_tax") * 500).alias("tax"))
    tree = wd.ward_tree(t, ["l_quantity", "discount", "tax"])
    held = tree.leaves.agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"))
    steps = tree.merges.select("step", "cost").withColumn("step", F.col("step") + 1).withColumnRenamed("cost", "before")
    made = tree.merges.agg(F.sum("cost").alias("cost"))
    rising = tree.merges.join(steps, "step").agg(F.bool_and(F.col("cost") >= F.col("before")).alias("rising"))
    return held.crossJoin(made).crossJoin(rising).select("n", rounded(F.col("ss") + F.col("cost"), 1).alias("spread"), "rising")


NATIONS = """(select c_nationkey as id, avg(o_totalprice) / 1000 as x, count(*) * 1.0 / count(distinct c_custkey) as y, avg(c_acctbal) / 100 as z
  from orders join customer on o_custkey = c_custkey group by c_nationkey)"""


@query("Q26_ward_nations", f"""
with recursive p as materialized (select *, count(*) over () as m from {NATIONS}),
w as (select 0 as step, m, id, id as label, x, y, z from p
  union all
  select step + 1, m, id, case when label = b then a else label end, x, y, z from w,
    (with g as (select label, count(*) as n, avg(x) as x, avg(y) as y, avg(z) as z from w group by label)
     select f.label as a, h.label as b from g f join g h on f.label < h.label
     order by f.n * h.n * 1.0 / (f.n + h.n) * (pow(f.x - h.x, 2) + pow(f.y - h.y, 2) + pow(f.z - h.z, 2)) limit 1)
  where step < m - 4)
select cast(id as bigint) as nation, cast(label as bigint) as smallest from w where step = (select max(step) from w)""")
def ward_nations(spark, d):
    """Four groups of nations by their customers' orders, named by their smallest nation."""
    t = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        (F.avg("o_totalprice") / 1000).alias("x"), (F.count(F.lit(1)) / F.count_distinct("c_custkey")).alias("y"), (F.avg("c_acctbal") / 100).alias("z"))
    out = wd.ward(t, ["x", "y", "z"], 4)
    named = out.groupBy("cluster").agg(F.min("c_nationkey").alias("smallest"))
    return out.join(named, "cluster").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("smallest").cast("long").alias("smallest"))


SCALED = """(select s_suppkey as id, (s_acctbal - avg(s_acctbal) over ()) / stddev_pop(s_acctbal) over () as a,
  (s_nationkey - avg(s_nationkey) over ()) / stddev_pop(s_nationkey) over () as b from supplier)"""


@query("Q27_dbscan", f"""
with recursive p as materialized (select * from {SCALED}), near as (select x.id as i, y.id as j from p x, p y where sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) <= 0.35),
core as (select i from near group by 1 having count(*) >= 4),
reach as (select i, i as j from core union select r.i, n.j from reach r join near n on n.i = r.j where n.j in (from core)),
label as (select i, min(j) as label from reach group by 1),
num as (select label, row_number() over (order by label) - 1 as cluster from (select distinct label from label)),
own as (select p.id, coalesce((select label from label where i = p.id), (select label from label l where l.i = (select min(n.j) from near n where n.i = p.id and n.j in (from core)))) as label from p)
select id as s_suppkey, cast(coalesce(cluster, -1) as int) as cluster from own left join num using (label)""")
def density(spark, d):
    t, names = cl.scaled_vectors(table(spark, d, "supplier"), ["s_acctbal", "s_nationkey"])

    points = t.withColumn("v", vector_to_array(cl.SCALED)).select("s_suppkey", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    return dbscan(points, "s_suppkey", ["a", "b"], 0.35, 4)


EIGHT = " + ".join(f"(x.v[{i}] - y.v[{i}]) * (x.v[{i}] - y.v[{i}])" for i in range(1, 9))


@query("Q27_dbscan_eight_columns", f"""
with recursive p as materialized (select vec_id as id, embedding::double[] as v from embeddings where len(embedding) >= 8 and list_aggregate(list_transform(embedding[1:8], lambda e: cast(e is null or isnan(e) as int)), 'sum') = 0),
near as materialized (select x.id as i, y.id as j from p x, p y where sqrt({EIGHT}) <= 0.22), core as materialized (select i from near group by 1 having count(*) >= 4),
reach as (select i, i as j from core union select r.i, n.j from reach r join near n on n.i = r.j where n.j in (from core)),
label as (select i, min(j) as label from reach group by 1),
num as (select label, row_number() over (order by label) - 1 as cluster from (select distinct label from label)),
border as (select n.i as id, min(n.j) as j from near n where n.j in (from core) and n.i not in (from core) group by 1),
own as (select i as id, label from label union all select b.id, l.label from border b join label l on l.i = b.j)
select p.id as vec_id, cast(coalesce(cluster, -1) as int) as cluster from p left join own using (id) left join num using (label)""")
def density_eight(spark, d):
    names = [f"e{i}" for i in range(8)]
    points = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return dbscan(points, "vec_id", names, 0.22, 4)


@query("Q28_elbow")
def elbow(spark, d):
    return cl.elbow(table(spark, d, "part"), ["p_size", "p_retailprice"])


@query("Q29_explained_spread", f"""
with c as (select abs(corr(l_quantity, l_extendedprice)) as r from lineitem)
select 1 as component, {r('50 * (1 + r)')} as explained_pct from c union all select 2, {r('50 * (1 - r)')} from c""")
def explained(spark, d):
    return show(cl.principal_components(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])[1])


def baskets(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")


BASKETS = "(select distinct l_orderkey as t, p_brand as i from lineitem join part on l_partkey = p_partkey)"


@query("Q30_pair_rules", f"""
with b as (select * from {BASKETS}), n as (select count(distinct t) * 1.0 as n from b), f as (select i, count(*) as c from b, n group by i, n.n having count(*) >= 0.005 * n.n),
p as (select x.i as a, y.i as c, count(*) as k from b x join b y on x.t = y.t and x.i <> y.i where x.i in (select i from f) and y.i in (select i from f) group by 1, 2)
select a as antecedent, p.c as consequent, {r('k / n.n', 6)} as support, {r('k * 1.0 / fa.c', 6)} as confidence, {r('(k * 1.0 / fa.c) / (fc.c / n.n)', 5)} as lift
from p join f fa on fa.i = a join f fc on fc.i = p.c, n where k >= 0.005 * n.n and k * 1.0 / fa.c >= 0.1 and (k * 1.0 / fa.c) / (fc.c / n.n) >= 0.9""")
def pair_rules(spark, d):
    out = bk.pair_rules(baskets(spark, d), "l_orderkey", "p_brand", 0.005, 0.1, 0.9, None)
    return out.select("antecedent", "consequent", rounded("support", 6).alias("support"), rounded("confidence", 6).alias("confidence"), rounded("lift", 5).alias("lift"))


@query("Q30_frequent_itemsets", f"""
with b as (select * from {BASKETS}), n as (select count(distinct t) * 1.0 as n from b),
s as (select i as items, count(*) as k from b group by 1 union all select x.i || ',' || y.i, count(*) from b x join b y on x.t = y.t and x.i < y.i group by x.i, y.i
  union all select x.i || ',' || y.i || ',' || z.i, count(*) from b x join b y on x.t = y.t and x.i < y.i join b z on x.t = z.t and y.i < z.i group by x.i, y.i, z.i)
select items, {r('k / n.n', 6)} as support from s, n where k >= 0.01 * n.n""")
def itemsets(spark, d):
    out = bk.frequent_itemsets(baskets(spark, d), "l_orderkey", "p_brand", 0.01)
    return out.select(F.array_join("items", ",").alias("items"), rounded("support", 6).alias("support"))


@query("Q30_fpgrowth_rules", f"""
with b as (select * from {BASKETS}), n as (select count(distinct t) * 1.0 as n from b), f as (select i, count(*) * 1.0 as c from b group by 1),
p as (select x.i as a, y.i as c, count(*) as k from b x join b y on x.t = y.t and x.i <> y.i group by 1, 2)
select a as antecedent, p.c as consequent, {r('k / fa.c', 6)} as confidence, {r('(1 - fc.c / n.n) / (1 - k / fa.c)', 5)} as conviction
from p join f fa on fa.i = a join f fc on fc.i = p.c, n where k >= 0.01 * n.n and k / fa.c >= 0.1""")
def fp_rules(spark, d):
    out = bk.association_rules(baskets(spark, d), "l_orderkey", "p_brand", 0.01, 0.1, 0.0, None)
    return out.select("antecedent", "consequent", rounded("confidence", 6).alias("confidence"), rounded("conviction", 5).alias("conviction"))


@query("Q31_customer_segments")
def customer_segments(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("order_frequency"), F.sum("o_totalprice").alias("spend"))
    return cl.customer_segments(t).sizes


@query("Q31_product_groups")
def product_groups(spark, d):
    return cl.product_groups(table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))).sizes


@query("Q31_behaviour_segments")
def behaviour(spark, d):
    t = table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey").agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.max("s_acctbal").alias("balance"))
    return cl.behaviour_segments(t, "s_suppkey").rows.select("s_suppkey", "cluster")


@query("Q31_market_basket", f"""
with e as (select distinct user_id as u, event_type as i from events), n as (select count(distinct u) * 1.0 as n from e),
t as (select i, row_number() over (order by i) - 1 as k from (select distinct i from e)),
b as (select u, sum(1 << k) as m from e join t using (i) group by u),
a as (select unnest(range(1, (select 1 << count(*) from t))) as m),
s as (select a.m, count(*) * 1.0 as c from a join b on cast(b.m as bigint) & a.m = a.m group by a.m),
names as (select m, string_agg(i, ', ' order by i) as name from a join t on (m >> k) & 1 = 1 group by m)
select names.name as antecedent, t.i as consequent, {r('w.c / n.n', 6)} as support, {r('w.c / x.c', 6)} as confidence, {r('w.c / x.c / (y.c / n.n)', 5)} as lift
from s x join t on (x.m >> t.k) & 1 = 0 join s w on w.m = x.m + (1 << t.k) join s y on y.m = (1 << t.k) join names on names.m = x.m, n
where w.c >= 0.05 * n.n and w.c / x.c >= 0.1 and w.c / x.c / (y.c / n.n) >= 1""")
def market_basket(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user"), "event_type")
    out = cl.market_basket(t)
    return out.select("antecedent", "consequent", rounded("support", 6).alias("support"), rounded("confidence", 6).alias("confidence"), rounded("lift", 5).alias("lift"))


# ---- neighbours --------------------------------------------------------------------------------------

@query("Q11_knn_classify", """
with s as (select avg(c_acctbal) ma, stddev_pop(c_acctbal) sa, avg(c_nationkey) mn, stddev_pop(c_nationkey) sn from customer),
n as (select s_suppkey, c_mktsegment, row_number() over (partition by s_suppkey order by sqrt(pow((s_acctbal - c_acctbal) / sa, 2) + pow((s_nationkey - c_nationkey) / sn, 2)), c_custkey) as k
  from supplier, customer, s),
v as (select s_suppkey, c_mktsegment, count(*) as votes from n where k <= 5 group by 1, 2)
select s_suppkey, c_mktsegment as prediction from v qualify row_number() over (partition by s_suppkey order by votes desc, c_mktsegment) = 1""")
def knn(spark, d):
    known = table(spark, d, "customer").selectExpr("c_custkey as id", "c_acctbal as bal", "c_nationkey as nation", "c_mktsegment as segment")
    asked = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_acctbal as bal", "s_nationkey as nation")
    return nb.knn_predict(known, asked, "id", ["bal", "nation"], "segment", 5).select(F.col("id").alias("s_suppkey"), "prediction")


@query("Q11_knn_regress", f"""
with n as (select s_suppkey, o.c_acctbal as y, row_number() over (partition by s_suppkey order by sqrt(pow(s_acctbal - c_acctbal, 2) + pow(s_nationkey - c_nationkey, 2)), c_custkey) as k
  from supplier, customer o)
select s_suppkey, {r('avg(y)', 3)} as prediction from n where k <= 3 group by 1""")
def knn_regress(spark, d):
    known = table(spark, d, "customer").selectExpr("c_custkey as id", "c_acctbal as bal", "c_nationkey as nation", "c_acctbal as y")
    asked = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_acctbal as bal", "s_nationkey as nation")
    return nb.knn_predict(known, asked, "id", ["bal", "nation"], "y", 3, scale=False).select(
        F.col("id").alias("s_suppkey"), rounded("prediction", 3).alias("prediction"))


@query("J9_knn_impute", f"""
with t as (select c_custkey, c_nationkey * 400.0 as nation, c_custkey % 97 as x, case when c_custkey % 23 = 0 then null else c_acctbal end as bal from customer),
n as (select a.c_custkey, b.bal, row_number() over (partition by a.c_custkey order by pow(a.nation - b.nation, 2) + pow(a.x - b.x, 2), b.c_custkey) as k
  from t a, t b where a.bal is null and b.bal is not null)
select t.c_custkey, {r('coalesce(t.bal, v)', 3)} as bal from t left join (select c_custkey, avg(bal) as v from n where k <= 5 group by 1) f on f.c_custkey = t.c_custkey""")
def knn_impute(spark, d):
    t = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 400.0).alias("nation"), (F.col("c_custkey") % 97).alias("x"),
                                           F.when(F.col("c_custkey") % 23 != 0, F.col("c_acctbal")).alias("bal"))
    return nb.knn_impute(t, "c_custkey").select("c_custkey", rounded("bal", 3).alias("bal"))


GAPS = "pow(a.nation - b.nation, 2)", "pow(a.x - b.x, 2)", "pow(a.bal - b.bal, 2)"
SHARED = "(cast(a.nation - b.nation is not null as int) + cast(a.x - b.x is not null as int) + cast(a.bal - b.bal is not null as int))"


def gap_fill(c: str) -> str:
    return f"""n_{c} as (select a.c_custkey, b.{c} as v, row_number() over (partition by a.c_custkey order by
  sqrt(coalesce({GAPS[0]}, 0) + coalesce({GAPS[1]}, 0) + coalesce({GAPS[2]}, 0)) * sqrt(3.0::double / {SHARED}), b.c_custkey) as k
  from t a, t b where a.{c} is null and b.{c} is not null and {SHARED} > 0), f_{c} as (select c_custkey, avg(v) as v from n_{c} where k <= 4 group by 1)"""


@query("J9_knn_impute_many_gaps", f"""
with t as (select c_custkey, case when c_custkey % 11 <> 0 then c_nationkey * 400.0::double end as nation, case when c_custkey % 17 <> 0 then cast(c_custkey % 97 as double) end as x,
  case when c_custkey % 5 <> 0 then c_acctbal end as bal from customer), {gap_fill("nation")}, {gap_fill("x")}, {gap_fill("bal")}
select t.c_custkey, """ + ", ".join(r(f"coalesce(t.{c}, f_{c}.v, (select quantile_cont({c}, 0.5) from t))", 3) + f" as {c}" for c in ("nation", "x", "bal")) + """
from t left join f_nation using (c_custkey) left join f_x using (c_custkey) left join f_bal using (c_custkey)""")
def knn_impute_many_gaps(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select("c_custkey", F.when(k % 11 != 0, F.col("c_nationkey") * 400.0).alias("nation"),
                                           F.when(k % 17 != 0, (k % 97).cast("double")).alias("x"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("bal"))
    return show(nb.knn_impute(t, "c_custkey", k=4), 3)


@query("J15_local_outlier_factor", f"""
with n as materialized (select a.c_custkey as i, b.c_custkey as j, sqrt(pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.c_nationkey * 100 - b.c_nationkey * 100, 2)) as dist,
  row_number() over (partition by a.c_custkey order by pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.c_nationkey * 100 - b.c_nationkey * 100, 2), b.c_custkey) as k
  from customer a, customer b where a.c_custkey <> b.c_custkey qualify k <= 20),
kd as (select i, max(dist) as kd from n group by 1), lrd as (select n.i, 1 / (avg(greatest(dist, kd)) + 1e-10) as lrd from n join kd on kd.i = n.j group by 1)
select n.i as c_custkey, {r('avg(b.lrd / a.lrd)')} as lof from n join lrd a on a.i = n.i join lrd b on b.i = n.j group by 1""")
def lof(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") * 100).alias("nation"))
    return show(nb.local_outlier_factor(t, "c_custkey", ["c_acctbal", "nation"]))


@query("J14_isolation_forest")
def isolation(spark, d):
    return iso.isolation_scores(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


@query("J14_J16_model_outliers_removed")
def removed(spark, d):
    return iso.model_outliers(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], action="remove").select("c_custkey")


@query("J16_model_outliers_capped", f"""
with q as (select quantile_cont(c_acctbal, 0.01) as lo, quantile_cont(c_acctbal, 0.99) as hi from customer)
select c_custkey, {r('least(greatest(c_acctbal, lo), hi)')} as c_acctbal from customer, q""")
def capped(spark, d):
    return show(iso.model_outliers(table(spark, d, "customer"), "c_custkey", ["c_acctbal"], action="cap").select("c_custkey", "c_acctbal"))
