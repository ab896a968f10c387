"""Regular-expression spans with code-point offsets, in built-in column functions only.

Spark can list the matches of a pattern but not where they are.  The text between
matches comes from ``split``, so a match starts at the summed length of all gaps and
matches before it.  Sums are built in blocks of BLOCK matches: appending to an array
inside ``aggregate`` copies it, and blocks keep that from growing with the square of
the number of matches in a very long text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def any_case(word: str) -> str:
    """Pattern for ``word`` with ASCII letters in either case, alike in Java and RE2."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in word)


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str) -> Column:
    """Texts before, between and after the matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def starts(hit: Column, gap: Column) -> Column:
    """Start offset of each match, from the arrays of matches and gaps."""
    empty = F.array().cast("array<long>")

    def span(i: Column) -> Column:
        return (F.length(F.get(gap, i)) + F.length(F.get(hit, i))).cast("long")

    def last(k: Column) -> Column:
        return F.least(F.size(hit), (k + 1) * BLOCK) - 1

    blocks = F.sequence(F.lit(0), F.floor((F.size(hit) - 1) / BLOCK).cast("int"))
    totals = F.transform(
        blocks,
        lambda k: F.aggregate(
            F.sequence(k * BLOCK, last(k)), F.lit(0).cast("long"), lambda a, i: a + span(i)
        ),
    )
    bases = F.aggregate(
        totals,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("seen")),
        lambda a, n: F.struct(
            (a["at"] + n).alias("at"), F.concat(a["seen"], F.array(a["at"])).alias("seen")
        ),
        lambda a: a["seen"],
    )

    def inside(base: Column, k: Column) -> Column:
        return F.aggregate(
            F.sequence((k * BLOCK).cast("int"), last(k).cast("int")),
            F.struct(base.alias("at"), empty.alias("seen")),
            lambda a, i: F.struct(
                (a["at"] + span(i)).alias("at"),
                F.concat(a["seen"], F.array(a["at"] + F.length(F.get(gap, i)))).alias("seen"),
            ),
            lambda a: a["seen"],
        )

    return F.when(F.size(hit) == 0, empty).otherwise(F.flatten(F.transform(bases, inside)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")
