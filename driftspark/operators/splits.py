"""Leak-free splits: rows or whole groups, stratified, by ranks of seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import hash_rank


def seeded(seed: int, key: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}|"), key))


def bounded_cut(n: Column, ratio: float, low: int = 1, spare: int = 1) -> Column:
    """Rows of n on the left: the rounded share (half to even), within low and n - spare."""
    return F.greatest(F.lit(low).cast("long"), F.least(n - spare, F.bround(n * F.lit(ratio)).cast("long")))


def rank_split(df: DataFrame, strata: list[str], ratio: float, order: Column, side: str = "side") -> DataFrame:
    """df with "left" or "right": a lone row of a stratum is left, otherwise both sides get some."""
    ranked = hash_rank(df, strata, order)
    left = F.when(F.col("size") == 1, F.lit(True)).otherwise(F.col("rank") <= bounded_cut(F.col("size"), ratio))
    return ranked.withColumn(side, F.when(left, "left").otherwise("right")).drop("rank", "size")


def stratified(samples: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    return rank_split(samples, ["source", "label"], ratio, seeded(seed, F.col("sample_id")))


def compositions(samples: DataFrame, group: str) -> DataFrame:
    """Each group with the counts of sources and labels in it, as one string."""
    counts = samples.groupBy(group, "source", "label").agg(F.count(F.lit(1)).alias("n"))
    part = F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("label").cast("string"), F.col("n").cast("string"))
    return counts.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(part)), ",").alias("composition"), F.sum("n").alias("members"))


def grouped(samples: DataFrame, ratio: float, seed: int = 42, group: str = "split_group") -> DataFrame:
    """Whole groups to one side, stratified by what they consist of; a row without group is its own."""
    keyed = samples.withColumn("_group", F.coalesce(F.nullif(F.col(group), F.lit("")), F.col("sample_id")))
    sides = rank_split(compositions(keyed, "_group"), ["composition"], ratio, seeded(seed, F.col("_group")))
    return keyed.join(sides.select("_group", "side"), "_group").drop("_group")


def held_out(samples: DataFrame, ratio: float, seed: int = 42, group: str = "split_group") -> DataFrame:
    """Groups to train or test; a single group is all train."""
    keyed = samples.withColumn("_group", F.coalesce(F.nullif(F.col(group), F.lit("")), F.col("sample_id")))
    ranked = hash_rank(keyed.select("_group").distinct(), [], seeded(seed, F.col("_group")))
    train = (F.col("size") <= 1) | (F.col("rank") <= bounded_cut(F.col("size"), ratio))
    sides = ranked.select("_group", F.when(train, "train").otherwise("test").alias("split"))
    return keyed.join(sides, "_group").drop("_group")


def three_way(samples: DataFrame, pool_ratio: float = 0.8, train_ratio: float = 0.8, seed: int = 42, group: str = "split_group") -> DataFrame:
    """Groups to train, val or test; with one or two groups, held_out and then a stratified split of its train rows."""
    keyed = samples.withColumn("_group", F.coalesce(F.nullif(F.col(group), F.lit("")), F.col("sample_id")))
    ranked = hash_rank(keyed.select("_group").distinct(), [], seeded(seed, F.col("_group")))
    if len(ranked.select("_group").limit(3).collect()) <= 2:
        first = held_out(samples, pool_ratio, seed, group)
        parts = stratified(first.where("split = 'train'").drop("split"), train_ratio, seed)
        named = parts.withColumn("split", F.when(F.col("side") == "left", "train").otherwise("val")).drop("side")
        return named.unionByName(first.where("split = 'test'").select(*named.columns))
    pool = bounded_cut(F.col("size"), pool_ratio, low=2)
    train = F.greatest(F.lit(1).cast("long"), F.least(pool - 1, F.bround(pool * F.lit(train_ratio)).cast("long")))
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= pool, "val").otherwise("test")
    return keyed.join(ranked.select("_group", split.alias("split")), "_group").drop("_group")


def make_splits(samples: DataFrame, agent_source: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Agent runs to train, val and test by group; all others to train and val only."""
    agents = three_way(samples.where(F.col("source") == agent_source), 0.8, ratio, seed)
    rest = grouped(samples.where(F.col("source") != agent_source), ratio, seed)
    rest = rest.withColumn("split", F.when(F.col("side") == "left", "train").otherwise("val")).drop("side")
    return agents.unionByName(rest)


def missing_labels(splits: DataFrame) -> DataFrame:
    """The labels that a split lacks."""
    seen = splits.groupBy("split").agg(F.collect_set("label").alias("seen"))
    wanted = F.array(F.lit(0), F.lit(1))
    return seen.select("split", F.explode(F.array_except(wanted, "seen")).alias("missing"))


def leaks(splits: DataFrame, group: str = "split_group") -> DataFrame:
    """Groups that are in more than one split."""
    return splits.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def fraction(df: DataFrame, domain: str, share: float, order: Column) -> DataFrame:
    """Of each domain the rounded-down share of its rows, one at least."""
    if share >= 1:
        return df
    return hash_rank(df, [domain], order).where(F.col("rank") <= F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") * F.lit(share)))).drop("rank", "size")


def mini_group(pair: Column, group: Column, row: Column) -> Column:
    """What may not be torn apart in a mini subset: counterfactual pairs; any other row is alone."""
    has_pair = F.coalesce(pair, F.lit("")) != ""
    return (
        F.when(has_pair, F.concat(F.lit("pair::"), pair))
        .when(F.coalesce(group.startswith("cf:"), F.lit(False)), F.concat(F.lit("pair::"), group))
        .otherwise(F.concat(F.lit("single::"), row.cast("string")))
    )


def mini_subset(samples: DataFrame, positives: float, negatives: float, seed: int, key: str = "mini_key") -> DataFrame:
    """Whole groups by hash until each stratum has its share: the sum over members of their label's fraction, 1 at least."""
    weights = samples.groupBy(key).agg(F.sum(F.when(F.col("label") == 1, F.lit(positives)).otherwise(F.lit(negatives))).alias("weight"))
    groups = compositions(samples, key).join(weights, key).withColumn("_h", seeded(seed, F.col(key)))
    targets = groups.groupBy("composition").agg(F.greatest(F.lit(1.0), F.bround(F.round(F.sum("weight"), 9))).alias("target"))
    # All groups of a stratum have the same size, so the sum before a group follows from its rank.
    ranked = hash_rank(groups, ["composition"], F.col("_h"))
    chosen = ranked.join(targets, "composition").where((F.col("rank") - 1) * F.col("members") < F.col("target"))
    return samples.join(chosen.select(key), key, "left_semi")


def remap(steps: DataFrame, chosen: DataFrame, key: str = "sample_index") -> DataFrame:
    """Steps of the chosen samples with dense new numbers from 0; original_index keeps the old ones."""
    ids = chosen.select(key).distinct()
    span = 1 << 16
    buckets = ids.groupBy(F.floor(F.col(key) / span).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select("_b", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    numbers = ids.withColumn("_b", F.floor(F.col(key) / span)).join(buckets, "_b").select(F.col(key).alias("original_index"), (F.col("_before") + rank).cast("long").alias("_new"))
    return steps.withColumnRenamed(key, "original_index").join(numbers, "original_index").withColumnRenamed("_new", key)


def sample_ids(tasks: DataFrame, share: float, seed: int, key: str = "task_id", most: int | None = None) -> DataFrame:
    """A share of the distinct task ids (one at least), then at most `most` of them in order."""
    ids = tasks.select(key).distinct()
    if share < 1:
        ranked = hash_rank(ids, [], seeded(seed, F.col(key).cast("string")))
        ids = ranked.where(F.col("rank") <= F.greatest(F.lit(1).cast("long"), F.bround(F.col("size") * F.lit(share)).cast("long"))).select(key)
    return ids.orderBy(key).limit(most) if most is not None else ids
