"""Access logs (id, ts): patterns, importance, and which tier an item belongs to."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400e6


def access_stats(log: DataFrame, key: str = "id") -> DataFrame:
    """Per id: accesses, first, last, and the mean interval in whole seconds over the count.

    The running mean of intervals has a closed form, their sum over the number of accesses,
    so one aggregate over ``lag`` is enough."""
    w = Window.partitionBy(key).orderBy("ts")
    gap = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6)
    return (
        log.withColumn("__gap", gap)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("accesses"),
            F.min("ts").alias("first"),
            F.max("ts").alias("last"),
            (F.coalesce(F.sum("__gap"), F.lit(0)) / F.count(F.lit(1))).alias("mean_interval"),
        )
    )


def most_frequent(log: DataFrame, n: int, key: str = "id") -> DataFrame:
    by = log.groupBy(key).agg(F.count(F.lit(1)).alias("accesses"))
    return by.orderBy(F.desc("accesses"), key).limit(n)


def most_recent(log: DataFrame, n: int, key: str = "id") -> DataFrame:
    return log.groupBy(key).agg(F.max("ts").alias("last")).orderBy(F.desc("last"), key).limit(n)


def hourly(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys, F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("accesses"))


def weekday(log: DataFrame, *keys: str) -> DataFrame:
    """Monday is 0."""
    return log.groupBy(*keys, F.weekday("ts").alias("weekday")).agg(F.count(F.lit(1)).alias("accesses"))


def peak_hour(log: DataFrame, *keys: str) -> DataFrame:
    """The hour with most accesses; of equals the latest."""
    top = F.max(F.struct("accesses", "hour"))
    return hourly(log, *keys).groupBy(*keys).agg(top.getField("hour").alias("peak_hour"))


def next_access(stats: DataFrame) -> DataFrame:
    seconds = F.floor("mean_interval").cast("int")
    return stats.where("accesses > 1").withColumn(
        "next_access", F.col("last") + F.make_interval(secs=seconds)
    )


def neighbours(log: DataFrame, key: str = "id", by: tuple[str, ...] = ("session",), most: int = 5) -> DataFrame:
    """Up to ``most`` distinct ids accessed right before and after each id, by session."""
    w = Window.partitionBy(*by).orderBy("ts", key)
    steps = log.withColumns({"before": F.lag(key).over(w), "after": F.lead(key).over(w)})
    pick = lambda c: F.slice(F.sort_array(F.collect_set(c)), 1, most)
    return steps.groupBy(key).agg(pick("before").alias("predecessors"), pick("after").alias("successors"))


def regularity(log: DataFrame, key: str = "id") -> DataFrame:
    """Share of the busiest hour, damped under ten accesses, 0 under three."""
    by = hourly(log, key).groupBy(key).agg(F.sum("accesses").alias("n"), F.max("accesses").alias("top"))
    value = F.col("top") / F.col("n") * F.least(F.col("n") / 10, F.lit(1.0))
    return by.select(key, F.when(F.col("n") < 3, 0.0).otherwise(value).alias("regularity"))


def mean_hour(log: DataFrame, key: str = "id") -> DataFrame:
    return log.groupBy(key).agg(F.avg(F.hour("ts").cast("double")).alias("mean_hour"))


def importance(stats: DataFrame, now: Any) -> DataFrame:
    """Recency and frequency: 0.6 exp(-days / 7) + 0.4 min(n / 100, 1)."""
    age = _days(F.lit(now), F.col("last"))
    score = 0.6 * F.exp(-age / 7) + 0.4 * F.least(F.col("accesses") / 100, F.lit(1.0))
    return stats.withColumns({"importance": score, "confidence": F.lit(0.7)})


def learned_importance(features: DataFrame) -> DataFrame:
    """Sigmoid of weighted features in [0, 1]: recency, frequency, regularity, time of day,
    causal."""
    weights = {"recency": 0.35, "frequency": 0.25, "regularity": 0.15, "time_of_day": 0.10, "causal": 0.10}
    z = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.05))
    return features.withColumn("importance", 1 / (1 + F.exp(-z)))


def confidence(stats: DataFrame) -> DataFrame:
    span = _days(F.col("last"), F.col("first"))
    value = 0.7 * F.least(F.col("accesses") / 10, F.lit(1.0)) + 0.3 * F.least(span / 7, F.lit(1.0))
    return stats.withColumn("confidence", value)


def plan_tiers(
    scored: DataFrame, hot: int, warm: int, cold: int, score: str = "importance", key: str = "id"
) -> DataFrame:
    """A tier for each row: hot, warm, cold or deep, by score and capacity.

    Rows are taken by falling score; one that misses a full tier falls to the next.  Only the
    top hot + warm + cold rows can be in a tier, so a bounded top-k is ranked and the rest is
    deep: no window over all rows.
    """
    top = scored.where(F.col(score) >= 0.1).orderBy(F.desc(score), key).limit(hot + warm + cold)
    ranked = top.select(key, F.col(score).alias("__s")).withColumn("__r", F.row_number().over(Window.orderBy(F.desc("__s"), key)))
    is_hot = (F.col("__r") <= hot) & (F.col("__s") >= 0.6)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("__hot", is_hot)
    ranked = ranked.withColumn("__nh", F.count_if("__hot").over(everything))
    is_warm = ~F.col("__hot") & (F.col("__r") - F.col("__nh") <= warm) & (F.col("__s") >= 0.3)
    ranked = ranked.withColumn("__warm", is_warm)
    ranked = ranked.withColumn("__nw", F.count_if("__warm").over(everything))
    is_cold = F.col("__r") - F.col("__nh") - F.col("__nw") <= cold
    tier = F.when(F.col("__hot"), "hot").when(F.col("__warm"), "warm").when(is_cold, "cold").otherwise("deep")
    placed = ranked.select(key, tier.alias("tier"))
    return scored.join(placed, key, "left").withColumn("tier", F.coalesce("tier", F.lit("deep")))


ORDER = {"hot": 0, "warm": 1, "cold": 2, "deep": 3}


def transition(old: Column, new: Column) -> Column:
    """What a move between tiers is called: moves to the next tier have names, those that
    skip one are 'other'; null if there is none."""
    rank = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    a, b = F.element_at(rank, old), F.element_at(rank, new)
    return (
        F.when(a == b, None)
        .when(F.abs(a - b) > 1, "other")
        .when(new == "deep", "archive")
        .when(old == "deep", "restore")
        .when(b < a, "promote")
        .otherwise("demote")
    )


def fitness(items: DataFrame, references: DataFrame, now: Any, bonus: int = 1, key: str = "id") -> DataFrame:
    """References plus weighted descendants less whole days beyond a week; fit from 2 on."""
    refs = references.groupBy(F.col("dst").alias(key)).agg(F.count(F.lit(1)).alias("refs"))
    age = F.greatest(F.lit(0), F.floor(_days(F.lit(now), F.col("ts")) - 7))
    value = F.coalesce("refs", F.lit(0)) + F.coalesce("descendants", F.lit(0)) * bonus - age
    return items.join(refs, key, "left").withColumn("fitness", value).withColumn("fit", F.col("fitness") >= 2)


def demotions(stats: DataFrame, now: Any, idle_days: float, n: int, key: str = "id") -> DataFrame:
    """The n rows idle for longest, of those idle for more than ``idle_days``."""
    idle = _days(F.lit(now), F.col("last"))
    return stats.withColumn("idle", idle).where(F.col("idle") > idle_days).orderBy(F.desc("idle"), key).limit(n)


def lru_order(stats: DataFrame, key: str = "id") -> DataFrame:
    """Items from the one not used for longest on, with their place."""
    order = Window.orderBy("last", key)
    # places are ranked over (last, key) alone
    place = stats.select(key, "last").withColumn("place", F.row_number().over(order))
    return stats.join(place.select(key, "place"), key)


def predicates(score: Column, sure: Column) -> dict[str, Column]:
    """Tests of an importance and how sure it is; staying and leaving hot memory ask for the
    importance alone."""
    return {
        "weighted": score * sure,
        "stay_hot": score >= 0.6,
        "promote": (score >= 0.6) & (sure > 0.5),
        "demote": score < 0.3,
        "to_cold": (score < 0.3) & (sure > 0.3),
    }
