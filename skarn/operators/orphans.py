"""References to records that do not exist, kept as states that change deltas are merged into.

Reference state: one row per (ref_table, owner_id, name) with a signed count and the first time of the reference.
Existence state: one row per name with its latest change and the first time the name was seen. A name exists once or not
at all, so the signed changes of its existence (+1, 0, -1) add up to what its latest change leaves, 1 or 0, and that is
what is kept. Both states are built from deltas by one mergeable aggregate: a state that was written is merged with the
deltas that came later (:func:`merge`), without the changes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skarn.skew import salted_join

#: White space of Unicode, in the notation of Java patterns.
_BLANK = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}\x{FEFF}]"


def clean_name(c):
    """A name without white space around it; null when nothing is left."""
    return F.nullif(F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", ""), F.lit(""))


def reference_deltas(df: DataFrame, table: str, owner: str, name: str = "qualified_name", at: str = "created_at", sign: int = 1, more: tuple[Column, ...] = ()) -> DataFrame:
    """Deltas (ref_table, owner_id, name, more..., refs, first_at) of added (sign 1) or withdrawn (sign -1) reference rows; more: further columns of the key."""
    return df.select(
        F.lit(table).alias("ref_table"),
        F.col(owner).alias("owner_id"),
        clean_name(F.col(name)).alias("name"),
        *more,
        F.lit(sign).cast("bigint").alias("refs"),
        F.col(at).alias("first_at"),
    ).where("name is not null")


def reference_state(*deltas: DataFrame) -> DataFrame:
    """Sum of deltas or earlier states. Partial sums come before the shuffle; the owner in the key spreads a hot name."""
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return out.groupBy([c for c in out.columns if c not in ("refs", "first_at")]).agg(F.sum("refs").alias("refs"), F.min("first_at").alias("first_at"))


def existence_deltas(nodes: DataFrame, name: str = "qualified_name", at: str = "updated_at", removed: str = "removed_at") -> DataFrame:
    """Per change of a record: the state it leaves (1 exists, 0 removed) and its time."""
    return nodes.where(F.col(name).isNotNull()).select(
        F.col(name).alias("name"),
        F.struct(F.col(at).alias("at"), F.col(removed).isNull().cast("int").alias("present")).alias("last"),
        F.col(at).alias("seen_at"),
    )


def existence_state(*deltas: DataFrame) -> DataFrame:
    """Latest state and first time per name; of changes at the same time the one that leaves the record counts."""
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return out.groupBy("name").agg(F.max("last").alias("last"), F.min("seen_at").alias("seen_at"))


def merge(refs: DataFrame, existence: DataFrame, ref_deltas: list[DataFrame], node_deltas: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Written states brought up to date with later deltas. A reference whose count falls to zero stays in the state, so that
    deltas may come in any order; its time is that of the earliest of its rows, withdrawn ones included."""
    return reference_state(refs, *ref_deltas), existence_state(existence, *node_deltas)


def orphans(refs: DataFrame, existence: DataFrame) -> DataFrame:
    """Keys with positive references and no record: (ref_table, owner_id, qualified_name, reason, first_at).

    reason: missing (never a record), deleted (its latest state is removed), late (first seen after the reference).
    Defined cases: null and blank names are no references; a null owner is an owner of its own; without a time of the
    reference or of the record nothing is late; withdrawn references (count not positive) are no orphans.
    """
    ex = existence.select("name", F.col("last.present").alias("present"), "seen_at")
    joined = salted_join(refs.where("refs > 0"), ex, "name")
    reason = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("present") == 0, "deleted")
        .when(F.col("seen_at") > F.col("first_at"), "late")
    )
    return joined.withColumn("reason", reason).where("reason is not null").select(
        "ref_table", "owner_id", F.col("name").alias("qualified_name"), "reason", "first_at"
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, month of the first reference and reason."""
    month = F.date_format(F.timestamp_millis("first_at"), "yyyy-MM")
    return found.groupBy("ref_table", month.alias("month"), "reason").agg(
        F.count(F.lit(1)).alias("orphans"), F.count_distinct("qualified_name").alias("names")
    )
