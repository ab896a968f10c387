"""Secrets, told apart by who owns them.

Patterns propose candidates in every text.  The corpus then says what each candidate
value is: one that COPIED_OWNERS owners or COPIED_REPOS repositories hold is a copied
example, one that few repositories of few owners hold looks live.  A value is known by its
hash; only hashes, documents and owners are shuffled, never texts.

Frequencies are built in two steps that combine before the shuffle: first the distinct
(hash, owner, repository), then counts by hash.  A value that a third of all rows hold
is thus few rows for each map task.  Verdicts go back by a join on the hash; those of
values with a large share of all rows are broadcast.  Rows without a candidate take no part.

The base kinds stay whatever their verdict.  ``generic`` candidates (long mixed tokens
with no telling name) become spans only if they look live and one owner alone holds them.

Defined results: a null text counts as empty; null owners are one owner, and null
repositories of an owner one repository; a null ``doc_id`` is kept; repeated rows give
repeated results and count once as a repository; a very long text is scanned whole; an empty
table gives no rows.  Input columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import spans as S
from chronoframe.llm.shared import cut, join_facts

NAMES = "|".join(
    [*map(S.any_case, ("password", "passwd", "secret", "token")), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]
)
SIGN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"(?:{NAMES}){SIGN}[A-Za-z0-9+/_.=-]+"
PREFIX = rf"^(?:{NAMES}){SIGN}"
#: Kind, pattern, the same tried at the start of a run only, least length of the value.
KINDS = (
    ("assign", ASSIGN, ASSIGN, 12),
    ("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]++", 18),
    ("hex", "[0-9a-f]{16,}", "(?<![0-9a-f])[0-9a-f]{16,}+", 16),
    ("generic", "[A-Za-z0-9+/_-]{24,}", "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+", 24),
)
RANK = {k[0]: i for i, k in enumerate(KINDS)}
BASE = ("assign", "access", "hex")
#: A value with at least so many owners, or repositories, is an example.
COPIED_OWNERS, COPIED_REPOS = 3, 8


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def _found(kind: str, least: int, hit: Column, gap: Column) -> Column:
    start = S.starts(hit, gap)

    def one(h: Column, i: Column) -> Column:
        value = F.regexp_replace(h, PREFIX, "") if kind == "assign" else h
        return F.struct(
            F.get(start, i).alias("start"),
            F.lit(RANK[kind]).alias("rank"),
            (F.get(start, i) + F.length(h)).alias("end"),
            value.alias("value"),
        )

    def holds(s: Column) -> Column:
        long = F.length(s["value"]) >= least
        return long & _mixed(s["value"]) if kind == "generic" else long

    found = F.filter(F.transform(hit, one), holds)
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"], s["rank"], s["end"], F.sha2(s["value"], 256).alias("hash")
        ),
    )


def candidates(docs: DataFrame, text: str, *keys: Column) -> DataFrame:
    """``keys`` and ``found``, the candidates (start, rank, end, hash) of each text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(
        *keys, whole.alias("__text"), *(S.hits(whole, k[2]).alias(f"__hit_{k[0]}") for k in KINDS)
    )
    # the text is not carried past this step
    out = out.withColumns(
        {
            f"__gap_{name}": F.when(F.size(f"__hit_{name}") > 0, S.gaps(F.col("__text"), java))
            for name, _, java, _ in KINDS
        }
    ).drop("__text")
    found = [
        _found(name, least, F.col(f"__hit_{name}"), F.col(f"__gap_{name}"))
        for name, _, _, least in KINDS
    ]
    return out.withColumn("found", F.concat(*found)).drop(
        *(f"__{what}_{k[0]}" for what in ("hit", "gap") for k in KINDS)
    )


def ownership(held: DataFrame) -> DataFrame:
    """``hash``, ``n_owners``, ``n_repos`` and ``n`` (rows) of ``held`` (hash, owner, repo)."""
    once = held.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n")
    )


def scan(
    docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source"
) -> DataFrame:
    """``repo`` and ``secrets`` for each row: its spans with their owners and verdicts.

    ``secrets`` holds (start, rank, end, hash, n_owners, n_repos, live), by start and kind.
    """
    rows = candidates(docs, text, F.col(repo).alias("repo"), F.col(owner).alias("owner"))
    # numbers of rows are fixed by what is written
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "repo", "owner", F.explode("found").alias("c"))
    each = each.select("row", "repo", "owner", "c", F.col("c.hash").alias("hash"))
    live = (F.col("n_owners") < COPIED_OWNERS) & (F.col("n_repos") < COPIED_REPOS)
    known = cut(ownership(each.select("hash", "owner", "repo")).withColumn("live", live))
    judged = join_facts(each, known, ["hash"], "n")
    span = F.struct("c.start", "c.rank", "c.end", "c.hash", "n_owners", "n_repos", "live")
    kept = (F.col("c.rank") != RANK["generic"]) | (F.col("live") & (F.col("n_owners") == 1))
    whole = judged.groupBy("row").agg(
        F.first("repo").alias("repo"), F.array_sort(F.collect_list(F.when(kept, span))).alias("secrets")
    )
    none = F.array().cast(whole.schema["secrets"].dataType)
    without = rows.where(F.size("found") == 0).select(F.col("repo").alias(repo), none.alias("secrets"))
    return whole.select(F.col("repo").alias(repo), "secrets").union(without)


def join_spans(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])
        ),
        ",",
    )


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = scan(docs)

    def size(test) -> Column:
        return F.size(F.filter("secrets", test)).cast("long")

    def count(kind: str) -> Column:
        return size(lambda s: s["rank"] == RANK[kind]).alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return out.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(join_spans(base), 256).alias("base_sha256"),
        join_spans(F.col("secrets")).alias("spans"),
        size(lambda s: s["live"]).alias("n_live"),
        size(lambda s: ~s["live"]).alias("n_example"),
        F.array_join(
            F.transform("secrets", lambda s: F.concat_ws("/", s["n_owners"], s["n_repos"])), ","
        ).alias("held_by"),
    )


def _sql_spans(kind: str, pattern: str, least: int) -> str:
    q = pattern.replace("'", "''")
    value = f"regexp_replace(v, '{PREFIX.replace(chr(39), chr(39) * 2)}', '')" if kind == "assign" else "v"
    mixed = (
        " AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')"
        if kind == "generic"
        else ""
    )
    return f"""
      SELECT r, doc_id, source, {RANK[kind]} AS k, '{kind}' AS kind, s, s + length(v) AS e, sha256(val) AS hash
      FROM (
        SELECT r, doc_id, source, unnest(h) AS v,
          unnest(list_transform(range(1, len(h) + 1), lambda i:
            CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s,
          {value} AS val
        FROM (SELECT r, doc_id, source, regexp_extract_all(t, '{q}') AS h,
                string_split_regex(t, '{q}') AS g FROM docs))
      WHERE length(val) >= {least}{mixed}"""


def oracle() -> str:
    base = ", ".join(f"'{k}'" for k in BASE)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    found = " UNION ALL ".join(_sql_spans(k, p, least) for k, p, _, least in KINDS)
    return f"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
    found AS ({found}),
    known AS (
      SELECT hash, count(DISTINCT coalesce(source, '<null>')) AS n_owners,
        count(DISTINCT coalesce(source, '<null>') || ':' || coalesce(CAST(doc_id AS VARCHAR), '<null>')) AS n_repos
      FROM found GROUP BY hash),
    judged AS (SELECT *, n_owners < {COPIED_OWNERS} AND n_repos < {COPIED_REPOS} AS live FROM known),
    kept AS (
      SELECT found.*, n_owners, n_repos, live FROM found JOIN judged USING (hash)
      WHERE kind <> 'generic' OR (live AND n_owners = 1))
    SELECT docs.doc_id, {counts},
      sha256(coalesce({joined} FILTER (kind IN ({base})), '')) AS base_sha256,
      coalesce({joined}, '') AS spans,
      count(*) FILTER (live) AS n_live,
      count(*) FILTER (NOT live) AS n_example,
      coalesce(string_agg(n_owners || '/' || n_repos, ',' ORDER BY s, k), '') AS held_by
    FROM docs LEFT JOIN kept USING (r) GROUP BY r, docs.doc_id"""
