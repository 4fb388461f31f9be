"""Exports of graphs and tables, and upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _xml(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document: (part, value); written in the order of ``part`` they are one file per partition."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="kind" for="all" attr.name="kind" attr.type="string"/><graph edgedefault="directed">')], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="kind">'), _xml(F.col("kind")), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('"><data key="kind">'), _xml(F.col("kind")), F.lit("</data></edge>")).alias("value"))
    return head.unionByName(n).unionByName(e).unionByName(spark.createDataFrame([(3, "</graph></graphml>")], "part int, value string"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = nodes.select(F.concat(F.lit("CREATE (:"), F.initcap("kind"), F.lit(" {id: "), q(F.col("id")), F.lit("});")).alias("value"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), q(F.col("source")), F.lit("}), (b {id: "), q(F.col("target")), F.lit("}) CREATE (a)-[:"), F.upper("kind"), F.lit("]->(b);")).alias("value"))
    return n.unionByName(e)


def notes(nodes: DataFrame, edges: DataFrame, each_way: int = 20) -> DataFrame:
    """One Markdown note per symbol with up to ``each_way`` calls in and out: (id, note)."""
    from pyspark.sql.window import Window

    calls = edges.where("kind = 'calls'").select("source", "target").distinct()
    few = lambda own, other: calls.withColumn("k", F.row_number().over(Window.partitionBy(own).orderBy(other))).where(F.col("k") <= each_way).groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_set(other)).alias(other))
    j = nodes.select("id", "kind").join(few("source", "target"), "id", "left").join(few("target", "source"), "id", "left")
    links = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    return j.select("id", F.concat(F.lit("# "), "id", F.lit("\n\n"), "kind", F.lit("\n\n## Calls\n"), links(F.col("target")), F.lit("\n\n## Called by\n"), links(F.col("source"))).alias("note"))


def components(dependencies: DataFrame) -> DataFrame:
    """Components of a bill of materials as JSON text: (purl, component)."""
    purl = F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name", F.lit("@"), F.coalesce("version", F.lit("")))
    return dependencies.select(purl.alias("purl"), F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", purl.alias("purl"))).alias("component"))


def from_components(rows: DataFrame) -> DataFrame:
    """Back from components to dependencies: (ecosystem, name, version)."""
    c = F.from_json("component", "struct<type string, name string, version string, purl string>")
    return rows.select(c.alias("c")).select(F.regexp_extract("c.purl", r"^pkg:([^/]+)/", 1).alias("ecosystem"), "c.name", "c.version")


def save_upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """Write old and new rows, new ones instead of old ones of their key, to another path than the old rows' own."""
    from skarn.operators.documents import upsert

    upsert(old, new, keys).write.mode("overwrite").parquet(path)


def delete_by_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of other files, and edges of which both ends remain or were never nodes of these files."""
    gone = nodes.join(files.select("file_path"), "file_path", "left_semi").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(files.select("file_path"), "file_path", "left_anti"), kept.select(*edges.columns)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a table, which ``df`` may read: the new one is written beside it and takes its place by renaming, so that a
    failed write leaves the old one as it was."""
    import uuid

    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    base = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{base}.new")
    had = system.exists(at(path))
    if had and not system.rename(at(path), at(f"{base}.old")):
        raise OSError(f"can't move {path}")
    if not system.rename(at(f"{base}.new"), at(path)):
        if had:
            system.rename(at(f"{base}.old"), at(path))
        raise OSError(f"can't move the new table to {path}")
    if had:
        system.delete(at(f"{base}.old"), True)


def save_label(df: DataFrame, path: str, label: str, by: str = "label") -> None:
    """One snapshot or branch as a partition of a table; saving a label again replaces that label only."""
    df.withColumn(by, F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def labels(spark, path: str, by: str = "label") -> list[str]:
    """Labels that are saved, from the names of the partitions."""
    from urllib.parse import unquote

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [s.getPath().getName() for s in listed if s.isDirectory()]
    return sorted(unquote(n.split("=", 1)[1]) for n in names if n.startswith(f"{by}="))


def remove_label(spark, path: str, label: str, by: str = "label") -> None:
    """Removes a snapshot or branch; others, and a label that isn't there, stay as they are."""
    from urllib.parse import unquote

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in system.listStatus(folder):
        if s.isDirectory() and unquote(s.getPath().getName()) == f"{by}={label}":
            system.delete(s.getPath(), True)


def keep_labels(spark, path: str, alive: list[str], by: str = "label") -> list[str]:
    """Garbage collection: removes all labels but those that are alive; the removed ones."""
    gone = [x for x in labels(spark, path, by) if x not in set(alive)]
    for x in gone:
        remove_label(spark, path, x, by)
    return gone


def vex(findings: DataFrame) -> DataFrame:
    """Statements of exploitability as JSON text from (cve, purl, verdict)."""
    state = F.when(F.col("verdict") == "affected", "exploitable").when(F.col("verdict") == "not_affected", "not_affected").otherwise("in_triage")
    why = F.when(F.col("verdict") == "not_affected", "code_not_reachable")
    body = F.struct(F.col("cve").alias("id"), F.struct(state.alias("state"), why.alias("justification")).alias("analysis"), F.array(F.struct(F.col("purl").alias("ref"))).alias("affects"))
    return findings.select("cve", F.to_json(body).alias("statement"))
