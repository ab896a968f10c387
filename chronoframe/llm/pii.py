"""Personal data: patterns propose, checksums confirm, context words adjust.

Every step is a built-in column function, so a text is read once, in one stage, without
a shuffle.  The four base kinds follow fixed patterns and stay whatever their score.
Two further kinds need more than a pattern: ``iban`` must pass mod-97 and ``natid``
must have a context word near it.

Defined results: a null text counts as empty and has no spans; a null ``doc_id`` is kept;
repeated rows give repeated results; an empty table gives no rows; other columns of the
input pass through ``scan`` unless they carry the name of one of its results, which then
replaces them.  A very long text is scanned whole: what stands around a match is looked up in
blocks of BLOCK code points, so that time grows with the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import spans as S

#: Code points before and after a match in which context words count.
BEFORE, AFTER = 40, 20
#: Code points of the blocks that a text with matches is cut into.
BLOCK = 1024
#: A span of a kind that the base does not keep needs this score.
KEEP = 60


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``java`` equals ``pattern`` match by match, but cannot backtrack: repeated groups are
    possessive and a run of characters is tried from its start only.
    """

    name: str
    pattern: str
    java: str
    score: int
    boost: int
    words: tuple[str, ...]
    base: bool = True

    @property
    def context(self) -> str:
        """The words by themselves, or with an s for more than one."""
        return f"(?:^|[^A-Za-z])(?:{'|'.join(map(S.any_case, self.words))})[Ss]?(?:[^A-Za-z]|$)"

    def may_hold(self, text: Column) -> Column:
        """A cheap test that every text with a match passes."""
        sign = {"email": "@", "phone": "+"}.get(self.name)
        return F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9]")


KINDS = (
    Kind(
        "email",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        90, 5, ("mail", "email", "mailto", "contact", "write to"),
    ),
    Kind(
        "ip",
        r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        60, 30, ("ip", "host", "server", "address"),
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        r"[0-9](?:[\x20-]?[0-9])++",
        80, 15, ("card", "visa", "credit", "payment"),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        60, 30, ("phone", "telephone", "call", "tel", "fax", "mobile"),
    ),
    Kind(
        "iban",
        r"[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
        r"[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
        85, 10, ("iban", "bank", "account", "konto"), base=False,
    ),
    Kind(
        "natid",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        40, 45, ("ssn", "social security", "national id"), base=False,
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _mod97(value: Column) -> Column:
    """True for an account number whose rearranged digits leave 1 when divided by 97."""
    code = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a < 65, (acc * 10 + a - 48) % 97).otherwise((acc * 100 + a - 55) % 97)

    left = F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step)
    return F.length(code).between(15, 34) & (left == 1)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":

        def small(part: Column) -> Column:
            n = F.regexp_replace(part, "^0+", "")
            return (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255"))

        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        n = S.digits(hit)
        return F.length(n).between(13, 19) & F.call_function("luhn_check", n)
    if kind == "phone":
        return F.length(S.digits(hit)).between(9, 15)
    if kind == "iban":
        return _mod97(hit)
    if kind == "natid":
        area = F.left(hit, F.lit(3))
        return ~area.isin("000", "666") & (area < "900")
    return F.lit(True)


def _around(blocks: Column, low: Column, high: Column) -> Column:
    """The text from ``low`` to ``high``, which are less than BLOCK apart."""
    block = F.floor(low / BLOCK).cast("int")
    both = F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit("")))
    return F.substring(both, (low - block * BLOCK + 1).cast("int"), (high - low).cast("int"))


def _matches(kind: Kind, hit: Column, start: Column) -> Column:
    """Array of (start, value) of the matches that hold."""
    found = F.transform(hit, lambda h, i: F.struct(F.get(start, i).alias("start"), h.alias("value")))
    return F.filter(found, lambda s: _valid(kind.name, s["value"]))


def _found(kind: Kind, matches: Column, blocks: Column) -> Column:
    """Array of (kind, start, end, score, value) of the matches that count."""

    def one(s: Column) -> Column:
        low, high = s["start"], s["start"] + F.length(s["value"])
        before = _around(blocks, F.greatest(low - BEFORE, F.lit(0)), low)
        near = before.rlike(kind.context) | _around(blocks, high, high + AFTER).rlike(kind.context)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            low.alias("start"),
            high.alias("end"),
            (F.lit(kind.score) + F.when(near, kind.boost).otherwise(0)).alias("score"),
            s["value"].alias("value"),
        )

    found = F.transform(matches, one)
    return found if kind.base else F.filter(found, lambda s: s["score"] >= KEEP)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``, the spans of every kind in order of kind, then start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    hit = {k: f"__hit_{k.name}" for k in KINDS}
    gap = {k: f"__gap_{k.name}" for k in KINDS}
    at = {k: f"__at_{k.name}" for k in KINDS}
    out = docs.withColumns({hit[k]: F.when(k.may_hold(whole), S.hits(whole, k.java)).otherwise(none) for k in KINDS})
    out = out.withColumns(
        {gap[k]: F.when(F.size(hit[k]) > 0, S.gaps(whole, k.java)) for k in KINDS}
    )
    out = out.withColumns({at[k]: S.starts(F.col(hit[k]), F.col(gap[k])) for k in KINDS})
    out = out.withColumns({hit[k]: _matches(k, F.col(hit[k]), F.col(at[k])) for k in KINDS})
    some = F.greatest(*(F.size(hit[k]) for k in KINDS)) > 0
    blocks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    out = out.withColumn("__blocks", F.when(some, blocks))
    found = [_found(k, F.col(hit[k]), F.col("__blocks")) for k in KINDS]
    return out.withColumn("pii", F.concat(*found)).drop(
        "__blocks", *hit.values(), *gap.values(), *at.values()
    )


def join_spans(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets.

    Where spans overlap, the one that starts first (then the longer) is replaced and what
    the others cover beyond it goes too.  A null text stays null.
    """
    names = docs.columns
    order = F.array_sort(
        F.transform(
            "pii", lambda s: F.struct(s["start"], (-s["end"]).alias("to"), s["kind"].alias("kind"))
        )
    )
    out = scan(docs, text).withColumn("__order", order)
    pieces = F.aggregate(
        "__order",
        F.struct(
            F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")
        ),
        lambda a, s: F.struct(
            F.greatest(a["at"], -s["to"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["parts"],
                    F.array(
                        F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
                    ),
                ),
            )
            .otherwise(a["parts"])
            .alias("parts"),
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, (a["at"] + 1).cast("int"))),
    )
    new = F.when(F.size("pii") > 0, pieces).otherwise(F.col(text))
    return out.withColumn(text, new).select(*names)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs).select("doc_id", "pii")

    def count(kind: str) -> Column:
        return F.size(of_kinds(F.col("pii"), (kind,))).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(join_spans(of_kinds(F.col("pii"), BASE)), 256).alias("base_sha256"),
        join_spans(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _sql_spans(kind: Kind) -> str:
    checks = {
        "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 "
        "OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": "length(d) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length(d) - i) % 2 = 1 "
        "THEN CASE WHEN CAST(d[i] AS INT) > 4 THEN CAST(d[i] AS INT) * 2 - 9 "
        "ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END "
        "FOR i IN range(1, length(d) + 1)]) % 10 = 0",
        "phone": "length(d) BETWEEN 9 AND 15",
        "iban": "length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, "
        "list_transform(string_split(replace(v, ' ', '')[5:] || replace(v, ' ', '')[:4], ''), "
        "lambda c: CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), "
        "lambda a, c: (CASE WHEN c < 10 THEN a * 10 ELSE a * 100 END + c) % 97) = 1",
        "natid": "v[:3] NOT IN ('000', '666') AND v[:3] < '900'",
    }
    least = "" if kind.base else f" AND score >= {KEEP}"
    return f"""
      SELECT r, {KINDS.index(kind)} AS k, '{kind.name}' AS kind, s, e, score FROM (
        SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d, s + length(v) AS e,
          {kind.score} + CASE WHEN regexp_matches(t[greatest(s - {BEFORE}, 0) + 1:s], '{kind.context}')
            OR regexp_matches(t[s + length(v) + 1:s + length(v) + {AFTER}], '{kind.context}') THEN {kind.boost} ELSE 0 END AS score
        FROM (
          SELECT r, t, unnest(h) AS v,
            unnest(list_transform(range(1, len(h) + 1), lambda i:
              CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
          FROM (SELECT r, t, regexp_extract_all(t, '{kind.pattern}') AS h,
                  string_split_regex(t, '{kind.pattern}') AS g FROM docs)))
      WHERE {checks.get(kind.name, "true")}{least}"""


def oracle() -> str:
    base = ", ".join(f"'{k}'" for k in BASE)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(map(_sql_spans, KINDS))})
    SELECT doc_id, {counts},
      sha256(coalesce({joined} FILTER (kind IN ({base})), '')) AS base_sha256,
      coalesce({joined}, '') AS spans,
      coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s), '') AS scores
    FROM docs LEFT JOIN found USING (r) GROUP BY r, doc_id"""
