"""URL filter: rules first, then two letter models.

Rules allow or block a host with its subdomains below a path; the longest that fits
decides.  URLs that no rule fits are judged by the ratio of two character models, one of
URLs that rules accept and one of those that rules reject.  The models are of variable
order: a character's probability after ORDER bytes is smoothed by its probability after
one byte less, and so on down to a uniform one.  The log-likelihood difference for each
character is compared with a threshold that is set on URLs left out of the counts.

Counts are exact and cover all URLs that a rule judges, once the threshold is set on one in
HELD of them with counts of the others.  They are kept for each distinct byte with its whole
context (a gram); lower orders are sums of these.  Up to GRAMS grams go to every task; more
stay a table, and the grams of URLs are joined with it.  Both ways give the same differences.

Defined results: a null URL, and one without ``://``, has an empty host and path and no
rule; a null or empty URL has a difference of 0; without URLs of both kinds every difference
is 0, and so is the threshold: 0 allows.  Repeated rows give repeated results; an empty table
gives no rows; a very long URL is read whole.  Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.shared import bounded_batches, cut, join_facts, release

ORDER = 4
#: Grams that are sent to tasks, at most: 24 bytes each.
GRAMS = 2_000_000
#: Weight of the lower order's probability, in observations.
STRENGTH = 4.0
#: One in so many judged URLs is left out of the counts, for the threshold.
HELD = 5
#: Differences are counted in bins of this width, within these bounds, for the threshold.
BIN, BOUND = 0.01, 5.0

#: Fixed values: (rule, verdict) as the contract lists them.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *_LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = name.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, name).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each URL: the ORDER bytes before it and itself in one number; and the
    number of bytes of each URL."""
    data = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    sizes = np.array([len(d) for d in data], np.int64)
    lead = b"\0" * ORDER
    b = np.frombuffer(b"".join(lead + d for d in data), np.uint8).astype(np.int64)
    keys = np.zeros(len(b), np.int64)
    for k in range(ORDER + 1):
        keys[k:] |= b[: len(b) - k] << (8 * k)
    starts = np.cumsum(sizes + ORDER) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return keys[at], sizes


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


class _Counts:
    """Counts by number."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts = np.stack([np.bincount(place, weights=c, minlength=len(self.keys)) for c in counts])

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[:, at], 0.0)


class UrlModel:
    """Both models, from grams and their counts in accepted and in rejected URLs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.both_kinds = bool(len(keys)) and bool((counts.sum(1) > 0).all())
        if self.both_kinds:
            self.both = [_Counts(keys & _mask(k + 1), counts) for k in range(ORDER + 1)]
            self.alone = [_Counts(keys >> 8 & _mask(k), counts) for k in range(ORDER + 1)]

    def ratio(self, keys: np.ndarray) -> np.ndarray:
        """Log-likelihood difference of each gram."""
        p = np.full((2, len(keys)), 1 / 256)
        for k in range(ORDER + 1):
            seen, all_ = self.both[k].of(keys & _mask(k + 1)), self.alone[k].of(keys >> 8 & _mask(k))
            p = (seen + STRENGTH * p) / (all_ + STRENGTH)
        return np.log(p[0]) - np.log(p[1])

    def differences(self, urls: list[str | None]) -> np.ndarray:
        """Log-likelihood difference for each byte of each URL: above 0, accepted is likelier."""
        keys, sizes = grams(urls)
        if not self.both_kinds or not len(keys):
            return np.zeros(len(urls))
        distinct, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(np.repeat(np.arange(len(urls)), sizes), weights=self.ratio(distinct)[place], minlength=len(urls))
        return sums / np.maximum(sizes, 1)


def _held(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(HELD)) == 0


def _counted(urls: DataFrame, labels: str) -> DataFrame:
    """(gram, label, n) of ``urls`` (url and an integer column ``labels``), by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = grams(batch.column(0).to_pylist())
            label = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            order = np.lexsort((keys, label))
            keys, label = keys[order], label[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (label[1:] != label[:-1])])[: len(keys)])
            n = np.diff(np.append(first, len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first]), pa.array(label[first]), pa.array(n, pa.int64())], names=["gram", "label", "n"]
            )
        release()

    return urls.select("url", F.col(labels).cast("long").alias(labels)).mapInArrow(run, "gram long, label long, n long")


KINDS = ("accepted", "rejected")


def count(judged: DataFrame) -> DataFrame:
    """(gram, accepted, rejected, accepted_fit, rejected_fit): counts in all of ``judged`` (url,
    accepted), and in those that aren't left out."""
    label = F.when(F.col("accepted"), 0).otherwise(1) + F.when(_held(F.col("url")), 2).otherwise(0)
    parts = _counted(judged.where(F.col("url").isNotNull()).withColumn("kind", label), "kind")

    def total(*labels: int) -> Column:
        return F.sum(F.when(F.col("label").isin(*labels), F.col("n")).otherwise(0))

    return parts.groupBy("gram").agg(
        total(0, 2).alias("accepted"), total(1, 3).alias("rejected"),
        total(0).alias("accepted_fit"), total(1).alias("rejected_fit"),
    )


def _by_tasks(rows: DataFrame, counts: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """``rows`` (with ``url``) with ``difference``, the counts sent to every task."""
    table = counts.select("gram", *kinds).toArrow()
    model = UrlModel(table.column(0).to_numpy(), np.stack([table.column(k).to_numpy() for k in kinds]).astype(float))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            yield pa.array(model.differences(urls.to_pylist()), pa.float64())
        release()

    return rows.withColumn("difference", F.arrow_udf(run, "double")("url"))


def _by_joins(rows: DataFrame, counts: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """The same, the grams of distinct URLs joined with the counts."""
    counts = counts.select("gram", *(F.col(k).cast("double").alias(f"c{m}") for m, k in enumerate(kinds)))
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("c0", "c1"))).first()
    urls = rows.select("url").where(F.length("url") > 0).distinct().withColumn("id", F.monotonically_increasing_id())
    urls = cut(urls)
    if not all(totals):
        return rows.withColumn("difference", F.lit(0.0))
    asked = cut(_counted(urls, "id"))
    p = {m: F.lit(1 / 256) for m in range(2)}
    known = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("weight"))
    for k in range(ORDER + 1):
        sums = [F.sum(f"c{m}").alias(f"s{k}{m}") for m in range(2)]
        gram = F.col("gram").bitwiseAND(F.lit(_mask(k + 1)))
        known = known.withColumn("key", gram).join(counts.groupBy(gram.alias("key")).agg(*sums), "key", "left")
        all_ = {m: F.lit(totals[m]) for m in range(2)}
        if k:
            context = F.shiftright("gram", 8).bitwiseAND(F.lit(_mask(k)))
            sums = [F.sum(f"c{m}").alias(f"a{k}{m}") for m in range(2)]
            known = known.withColumn("key", context).join(counts.groupBy(context.alias("key")).agg(*sums), "key", "left")
            all_ = {m: F.coalesce(f"a{k}{m}", F.lit(0.0)) for m in range(2)}
        for m in range(2):
            p[m] = (F.coalesce(f"s{k}{m}", F.lit(0.0)) + STRENGTH * p[m]) / (all_[m] + STRENGTH)
    known = cut(known.select("gram", (F.log(p[0]) - F.log(p[1])).alias("ratio"), "weight"))
    each = join_facts(asked, known, ["gram"], "weight")
    mean = each.groupBy(F.col("label").alias("id")).agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("difference"))
    found = urls.join(mean, "id").select("url", "difference")
    return rows.join(found, "url", "left").withColumn("difference", F.coalesce("difference", F.lit(0.0)))


def fit(judged: DataFrame):
    """For ``judged`` (url, accepted), URLs with what rules say of them: the function that adds
    ``difference`` to rows with ``url``, and the threshold."""
    counts = cut(count(judged))
    add = _by_tasks if counts.count() <= GRAMS else _by_joins
    left_out = judged.where(F.col("url").isNotNull() & _held(F.col("url")))
    scored = add(left_out, counts, tuple(f"{k}_fit" for k in KINDS))
    at = F.round(F.greatest(F.least("difference", F.lit(BOUND)), F.lit(-BOUND)) / BIN).cast("long")
    told = scored.groupBy(at.alias("bin"), "accepted").count().collect()
    return lambda rows: add(rows, counts, KINDS), _threshold([tuple(r) for r in told])


def _threshold(counts: list[tuple[int, bool, int]]) -> float:
    """The difference from which on to allow: least sum of both kinds' error rates; of
    several, the one nearest to 0."""
    good = sum(n for _, ok, n in counts if ok)
    bad = sum(n for _, ok, n in counts if not ok)
    if not good or not bad:
        return 0.0
    cuts = sorted({0, *(b for b, _, _ in counts), *(b + 1 for b, _, _ in counts)})

    def loss(cut: int) -> float:
        lost = sum(n for b, ok, n in counts if ok and b < cut) / good
        let = sum(n for b, ok, n in counts if not ok and b >= cut) / bad
        return lost + let

    return min(cuts, key=lambda c: (loss(c), abs(c))) * BIN - BIN / 2


def judge(pages: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, difference) of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path")
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "says": verdict})
    known = rows.where(F.col("says").isNotNull())
    add, threshold = fit(known.select("url", (F.col("says") == "allow").alias("accepted")))
    learned = F.when(F.col("difference") >= threshold, "allow").otherwise("block")
    return add(rows).select(
        F.col("page_id").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("says", learned).alias("verdict"),
        "difference",
    )


def op4_urls(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
