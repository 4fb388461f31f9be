"""Parent-child rows to full hierarchies: path, depth, root, descendants and loops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from skarn.session import cut, cut_counted, drop
from skarn.skew import current_rows, salted_join


@dataclass
class Hierarchy:
    """``reached``: id, parent_id, root_id, depth, path (ids from the root). ``unreached``: id, parent_id."""

    reached: DataFrame
    unreached: DataFrame

    def cycles(self) -> DataFrame:
        return loops(self.unreached)

    def descendants(self) -> DataFrame:
        """Every (ancestor_id, descendant_id, distance) pair of the reached part; a node isn't its own descendant."""
        return self.reached.select(
            F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor_id"),
            F.col("id").alias("descendant_id"),
            "depth",
        ).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def links_of(df: DataFrame, id: str, parent: str, updated: str | None) -> DataFrame:
    """Current (id, parent_id) rows; an empty parent is none."""
    up = F.col(updated) if updated else F.lit(0)
    rows = df.select(F.col(id).alias("id"), F.nullif(F.col(parent), F.lit("")).alias("parent_id"), up.alias("at"))
    return current_rows(rows, ["id"], "at").select("id", "parent_id")


def build(df: DataFrame, id: str = "id", parent: str = "parent_id", updated: str | None = "updated_at", with_paths: bool = True) -> Hierarchy:
    """Extend roots, depths and paths from the roots by frontier joins whose reach doubles.

    Roots are rows without a parent or whose parent is no row. A row that isn't reached yet knows an ancestor and the way
    below it; each round joins these rows with the state of that ancestor. If a root reaches the ancestor, it reaches the
    row, and else the way grows by the ancestor's own. Round t so reaches the levels up to 2**t - 1, and as levels have no
    gaps, a round that reaches nothing is the last one: what is left hangs on loops. A parent with a great share of the
    rows is salted. The number of rounds is the logarithm of the depth of the data, not a limit.

    Defined cases: null ids are no nodes; null and empty parents are none; the greatest ``updated`` row of an id counts;
    an empty table gives empty results; a node that is its own parent is a loop of one.
    """
    links = cut(links_of(df, id, parent, updated), "links")
    known = links.select(F.col("id").alias("parent_id"), F.lit(True).alias("has"))
    own = F.array(F.col("id")) if with_paths else F.array().cast("array<string>")
    start = salted_join(links, known, "parent_id").select(
        "id", F.when(F.col("has"), F.col("parent_id")).alias("parent_id"), F.when(F.col("has"), F.col("parent_id")).alias("up"),
        F.when(F.col("has").isNull(), F.col("id")).alias("root_id"), F.when(F.col("has"), 1).otherwise(0).alias("depth"), own.alias("path"),
    )
    is_open = F.col("root_id").isNull()
    state, n = cut_counted(start, "tree", F.count_if(is_open).alias("open"))
    drop(links)
    while n["open"]:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root_id").alias("root2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        # An ancestor is one row; where very many rows hang on one, the adaptive plan splits its partition.
        ahead = state.where(is_open).drop("root_id").join(above, "up").select(
            "id", "parent_id", F.col("up2").alias("up"), F.col("root2").alias("root_id"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.concat("path2", "path") if with_paths else F.col("path")).alias("path")
        )
        before, last = n["open"], state
        state, n = cut_counted(ahead.unionByName(state.where(~is_open)), "tree", F.count_if(is_open).alias("open"))
        drop(last)
        if n["open"] == before:
            break
    return Hierarchy(state.where(~is_open).select("id", "parent_id", "root_id", "depth", "path"), state.where(is_open).select("id", "parent_id"))


def loops(links: DataFrame) -> DataFrame:
    """Nodes on a loop of parent links, given rows that no root reaches: (cycle_id, id), cycle_id the smallest id.

    Every such row leads into a loop. All rows jump ahead by doubled distances, and rows that nothing jumps to leave. When
    none leaves, the jumps are a permutation: what is left are the loops. The jumps carry the smallest id seen; when it no
    longer changes anywhere, it is that of the loop. Rounds are logarithmic in the longest way.
    """
    jump = cut(links.select("id", F.col("parent_id").alias("to"), F.col("id").alias("low")), "jump")
    before = -1
    while True:
        ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        kept = jump.join(jump.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
        step = kept.join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        last = jump
        jump, seen = cut_counted(step, "jump", F.max("moved").alias("moved"))
        drop(last)
        if not seen["n"] or (seen["n"] == before and not seen["moved"]):
            return jump.select(F.col("low").alias("cycle_id"), "id")
        before = seen["n"]
