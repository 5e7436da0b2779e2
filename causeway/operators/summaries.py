"""Summaries over pairs and models, and the frames that plots read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.errors import DyadError
from causeway.functions.durable import durable, number_rows


def of_models(scores: DataFrame) -> DataFrame:
    """Each model's mean score over the pairs it is in, on either side."""
    both = scores.select(F.explode(F.array("ego_id", "alter_id")).alias("model_id"), "score")
    return both.groupBy("model_id").agg(F.count("*").alias("pairs"), F.avg("score").alias("mean_score"))


def unknown_rates(claims: DataFrame, by: str = "comp_id") -> DataFrame:
    return claims.groupBy(by).agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "unknown").alias("unknown"), F.avg((F.col("status") == "unknown").cast("double")).alias("unknown_rate"))


def status_heatmap(claims: DataFrame) -> DataFrame:
    """Claims with the places of their component and model by unknown rate, then name."""
    comp = number_rows(unknown_rates(claims), F.desc("unknown_rate"), "comp_id", name="component_order").select("comp_id", "component_order")
    model = number_rows(unknown_rates(claims, "model_id"), F.desc("unknown_rate"), "model_id", name="model_order").select("model_id", "model_order")
    return claims.join(F.broadcast(comp), "comp_id").join(model, "model_id").select("model_id", "comp_id", "status", "component_order", "model_order")


def adjustment_prevalence(profiles: DataFrame) -> DataFrame:
    """How many models have each robust set, and in how many pairs of models it is the only one shared.

    Models of the same sets are counted once: pairs are those of distinct collections of sets, weighted by their models.
    """
    alike = durable(profiles.where("robust_mas is not null").groupBy("robust_mas").agg(F.count("*").alias("n")).withColumn("k", F.xxhash64(F.to_json("robust_mas"))))
    sets = alike.select("k", "n", F.explode("robust_mas").alias("z"))
    a, b = sets.toDF("a", "na", "z"), sets.toDF("b", "nb", "z")
    one = F.count("*") == 1
    apart = a.join(b, "z").where("a < b").groupBy("a", "b").agg(one.alias("one"), F.first("z").alias("z"), F.first(F.col("na") * F.col("nb")).alias("pairs")).where("one").select("z", "pairs")
    within = alike.where(F.size("robust_mas") == 1).select(F.element_at("robust_mas", 1).alias("z"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    shared = apart.union(within).groupBy("z").agg(F.sum("pairs").alias("sole_in_pairs"))
    return sets.groupBy("z").agg(F.sum("n").alias("models")).join(shared, "z", "left").select(F.concat_ws(", ", "z").alias("adjustment_set"), "models", F.coalesce("sole_in_pairs", F.lit(0)).alias("sole_in_pairs"))


def most_prevalent(prevalence: DataFrame) -> DataFrame:
    """One row: the sets that most models have, and those that are the only one shared by most pairs; ties are joined by semicolons, no set at all is null."""
    top = prevalence.agg(F.max("models").alias("m"), F.max("sole_in_pairs").alias("s"))
    of = lambda c, m: F.array_join(F.array_sort(F.collect_list(F.when((F.col(c) == F.col(m)) & (F.col(c) > 0), F.concat(F.lit("{"), "adjustment_set", F.lit("}"))))), "; ")
    out = prevalence.crossJoin(F.broadcast(top)).agg(of("models", "m").alias("most_common"), F.max("m").alias("models"), of("sole_in_pairs", "s").alias("sole"), F.max("s").alias("sole_in_pairs"))  # one row is broadcast
    return out.select(F.nullif("most_common", F.lit("")).alias("most_common"), "models", F.nullif("sole", F.lit("")).alias("sole"), "sole_in_pairs")


def compatibility_share(dyads: DataFrame, *metrics: str) -> DataFrame:
    """(metric, available, pairs, compatible, share): of each metric the share of pairs that are compatible among those where it isn't null."""
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("ok")) for m in metrics))).alias("r")
    return dyads.select(rows).groupBy("r.metric").agg(F.count("r.ok").alias("available"), F.count("*").alias("pairs"), F.count_if("r.ok").alias("compatible")).withColumn("share", F.try_divide("compatible", "available"))


def identified_models(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count("*").alias("models"), F.count_if("identified").alias("identified"), F.count_if(~F.col("identified")).alias("not_identified"), F.count_if(F.col("identified").isNull()).alias("unavailable"))


def missing_components(profiles: DataFrame) -> DataFrame:
    """Nodes by the number of pairs of identified models of which just one holds them relevant: those that do times those that don't."""
    own = profiles.where("identified and nodes is not null").select("model_id", "nodes")
    total = own.agg(F.count("*").alias("total"))
    has = own.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    return has.crossJoin(F.broadcast(total)).select("node", (F.col("n") * (F.col("total") - F.col("n"))).alias("pairs")).where("pairs > 0").orderBy(F.desc("pairs"), "node")  # one row is broadcast


def shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs' scores (ego_id, alter_id, score) before and after, and the difference. Pairs must not repeat."""
    for name, df in (("before", before), ("after", after)):
        if twice := df.groupBy("ego_id", "alter_id").count().where("count > 1").first():
            raise DyadError(f"{twice['ego_id']}, {twice['alter_id']} is there {twice['count']} times {name}")
    a = after.select("ego_id", "alter_id", F.col("score").alias("post_score"))
    return before.join(a, ["ego_id", "alter_id"]).withColumn("change", F.bround(F.col("post_score") - F.col("score"), 6))


def shift_summary(shift_: DataFrame) -> DataFrame:
    return shift_.agg(F.avg("change").alias("mean_change"), F.count_if(F.col("change") > 0).alias("improved"), F.count_if(F.col("change") < 0).alias("worsened"), F.count_if(F.col("change") == 0).alias("unchanged"))


#: Kinds of clusters in the order of a heatmap.
LABELS = ("ghost", "mainstream", "fragmented", "noise", "unknown")


def cluster_order(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """(model_id, cluster_id, label, place): models in the order of LABELS, then by cluster and id. Models without a cluster are noise, clusters without a label unknown."""
    order = F.create_map(*(F.lit(x) for kv in zip(LABELS, range(len(LABELS)), strict=True) for x in kv))
    a = assignments.select("model_id", "cluster_id").join(F.broadcast(labels.select("cluster_id", "label")), "cluster_id", "left")
    a = a.withColumn("label", F.when(F.col("cluster_id").isNull(), "noise").otherwise(F.when(F.col("label").isin(*LABELS), F.col("label")).otherwise("unknown"))).withColumn("_o", order[F.col("label")])
    return number_rows(a, "_o", "cluster_id", "model_id", name="place").select("model_id", "cluster_id", "label", "place")


def cluster_breaks(ordered: DataFrame) -> DataFrame:
    """(cluster_id, label, position): where lines part one cluster's models from the next one's; none after the last."""
    ends = ordered.groupBy("cluster_id", "label").agg((F.max("place") + 0.5).alias("position"))
    last = ordered.agg((F.max("place") + 0.5).alias("_last"))
    return ends.crossJoin(F.broadcast(last)).where("position < _last").drop("_last")  # one row is broadcast


def heatmap(scores: DataFrame, assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with both sides' clusters and labels, in the order of LABELS."""
    a = durable(cluster_order(assignments, labels))
    e, t = (a.select(F.col("model_id").alias(f"{s}_id"), F.col("cluster_id").alias(f"{s}_cluster"), F.col("label").alias(f"{s}_label"), F.col("place").alias(f"{s}_place")) for s in ("ego", "alter"))
    return scores.join(e, "ego_id").join(t, "alter_id")


def label_centroids(embedding: DataFrame, ordered: DataFrame) -> DataFrame:
    """(label, x, y ..): where each label's models lie in the middle. ``ordered``: model_id, label."""
    axes = [c for c in embedding.columns if c != "model_id"]
    return embedding.join(ordered.select("model_id", "label"), "model_id").groupBy("label").agg(F.count("*").alias("models"), *(F.avg(c).alias(c) for c in axes))


def sample_pairs(pairs: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """n pairs by the hash of their ids: the same for a seed wherever they lie."""
    return pairs.orderBy(F.xxhash64(F.lit(seed), "ego_id", "alter_id"), "ego_id", "alter_id").limit(n)


def outliers(contrast: DataFrame, share: float = 0.9, top: int = 15) -> DataFrame:
    """Rows of (name, gap) at or above the percentile of the gap, the largest first."""
    cut = contrast.agg(F.percentile("gap", F.lit(share)).alias("cut"))
    return contrast.crossJoin(F.broadcast(cut)).where("gap >= cut").orderBy(F.desc("gap"), "name").limit(top)  # one row is broadcast


def sample_ids(models: DataFrame, n: int, seed: int = 42, group: str | None = None) -> DataFrame:
    """n models by the hash of their id: the same for a seed wherever they lie. ``group``: its first model each comes before."""
    key = F.xxhash64(F.lit(seed), "model_id")
    if group is None:
        return models.select("model_id").orderBy(key, "model_id").limit(n)
    first = F.row_number().over(Window.partitionBy(group).orderBy("model_id")) == 1
    return models.withColumn("_first", first).orderBy(F.desc("_first"), key, "model_id").select("model_id").limit(n)


def set_matrix(claims: DataFrame, outcome: str, components: list[str]) -> DataFrame:
    """A row a model: 1 where a component is claimed causal or present, and the outcome column."""
    on = F.col("status").isin("causal", "present").cast("int")
    return claims.groupBy("model_id").pivot("comp_id", components).agg(F.coalesce(F.max(on), F.lit(0))).na.fill(0).withColumn("outcome", F.lit(outcome))
