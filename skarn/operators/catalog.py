"""The catalog of datasets: listing, description, hints for made-up rows, lint, and links from source text to data files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skarn.skew import current_rows


def datasets(history: DataFrame) -> DataFrame:
    """The latest snapshot of each dataset: (dataset_id, snapshot_at, row_count, column_count, content_hash)."""
    s = history.where("dataset_id is not null and snapshot_at is not null").select("dataset_id", "snapshot_at", "row_count", "column_count", "content_hash")
    return current_rows(s, ["dataset_id"], "snapshot_at")


def describe(columns: DataFrame, dataset: str | None = None, name: str | None = None) -> DataFrame:
    """Current column profiles, of one dataset or one column where they are given; (dataset_id, position) is their order."""
    wanted = columns.where("dataset_id is not null and name is not null")
    wanted = wanted if dataset is None else wanted.where(F.col("dataset_id") == dataset)
    wanted = wanted if name is None else wanted.where(F.col("name") == name)
    return current_rows(wanted, ["dataset_id", "name"], "updated_at")


def _holds(name: Column, *words: str) -> Column:
    c = F.lit(False)
    for w in words:
        c = c | name.contains(w)
    return c


def sample_hints(columns: DataFrame, listed: DataFrame) -> DataFrame:
    """How to make up values of each column: (dataset_id, column_name, hint). Datasets without a snapshot have no hints."""
    c = describe(columns).join(listed.select("dataset_id", "row_count"), "dataset_id")
    known = F.col("min_value").isNotNull() & F.col("max_value").isNotNull()
    unique = F.col("cardinality") == F.col("row_count")
    between = lambda what: F.concat(F.lit(f"Random {what} between "), "min_value", F.lit(" and "), "max_value")
    low = F.lower("name")
    samples = F.coalesce("sample_values", F.array().cast("array<string>"))
    some = F.concat(F.lit("Random string ("), F.col("cardinality").cast("string"), F.lit(" distinct values in source)"))
    text = (
        F.when((F.col("cardinality") <= 10) & (F.col("row_count") > 20), F.concat(F.lit("Pick from: "), F.array_join(samples, ", ")))
        .when(
            unique,
            F.when(_holds(low, "email"), "Generate unique email (e.g. user{n}@example.com)")
            .when(_holds(low, "id", "uuid"), "Generate unique ID/UUID")
            .when(_holds(low, "name"), "Generate unique name string")
            .when(_holds(low, "url", "link"), "Generate unique URL")
            .otherwise(F.concat(F.lit("Generate unique string ("), F.col("cardinality").cast("string"), F.lit(" distinct in source)"))),
        )
        .otherwise(F.when(F.size(samples) > 0, F.concat(some, F.lit(". Examples: "), F.array_join(F.slice(samples, 1, 3), ", "))).otherwise(some))
    )
    hint = (
        F.when(F.col("inferred_type") == "integer", F.concat(F.when(known, between("integer")).otherwise("Random integer"), F.when(unique, " (must be unique)").otherwise("")))
        .when(F.col("inferred_type") == "float", F.when(known, F.concat(between("float"), F.coalesce(F.concat(F.lit(" (mean ≈ "), F.format_string("%.2f", F.round("mean_value", 2)), F.lit(")")), F.lit("")))).otherwise("Random float"))
        .when(F.col("inferred_type") == "boolean", "Random boolean (true/false)")
        .when(F.col("inferred_type") == "date", F.when((F.col("min_value") != "") & (F.col("max_value") != ""), between("date")).otherwise("Random ISO date string"))
        .when(F.col("inferred_type") == "string", text)
        .otherwise(F.concat(F.lit("Generate "), F.coalesce("inferred_type", F.lit("null")), F.lit(" value")))
    )
    nulls = F.when(F.col("nullable") & (F.col("null_pct") > 0.05), F.concat(F.lit(" — "), F.floor(F.col("null_pct") * 100 + 0.5).cast("string"), F.lit("% chance of null"))).otherwise("")
    return c.select("dataset_id", F.col("name").alias("column_name"), F.concat(hint, nulls).alias("hint"))


def lint(listed: DataFrame, columns: DataFrame, counted: DataFrame, refs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Integrity of the catalog: (dataset_id, severity, issue, expected, found).

    counted: (dataset_id, rows) as they are. A dataset without rows has no table; files: (dataset_id, content_hash) of
    the sources as they are now, a dataset without one has lost its source. References to no dataset are counted per
    dataset id. Null ids are left out.
    """
    profiles = describe(columns).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("profiles"))
    j = listed.join(counted.select("dataset_id", "rows"), "dataset_id", "left").join(profiles, "dataset_id", "left").withColumn("profiles", F.coalesce("profiles", F.lit(0)))
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c
    found = [
        (F.col("rows").isNull(), "error", "no rows", "row_count", F.lit("0")),
        (F.col("rows") != F.col("row_count"), "error", "row count", "row_count", "rows"),
        (F.col("profiles") != F.col("column_count"), "warning", "column count", "column_count", "profiles"),
    ]
    if files is not None:
        j = j.join(files.select("dataset_id", F.col("content_hash").alias("file_hash"), F.lit(True).alias("exists")), "dataset_id", "left")
        found.append((F.col("exists").isNull(), "error", "source missing", F.col("content_hash"), F.lit(None).cast("string")))
        found.append((F.col("exists") & ~F.col("file_hash").eqNullSafe(F.col("content_hash")), "warning", "content changed", F.col("content_hash"), F.col("file_hash")))
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"), text(e).alias("expected"), text(f).alias("found"))) for c, s, i, e, f in found]))
    own = j.select("dataset_id", F.explode(each).alias("i")).select("dataset_id", "i.*")
    lost = refs.where("dataset_id is not null").select("dataset_id", "qualified_name").join(listed.select("dataset_id"), "dataset_id", "left_anti").groupBy("dataset_id").agg(F.count(F.lit(1)).cast("string").alias("found"))
    return own.unionByName(lost.select("dataset_id", F.lit("warning").alias("severity"), F.lit("orphan refs").alias("issue"), F.lit("0").alias("expected"), "found"))


# Calls that read and write data files, and what names one; the first group is the path.
_QUOTED = r"\s*\(\s*['\"`]([^'\"`]+)['\"`]"
_WRITTEN = r"\s*\(\s*['\"`]([^'\"`]+\.(?:csv|tsv|jsonl|json|xlsx|parquet))['\"`]"
_PDF = r"\s*\(\s*['\"`]([^'\"`]+\.pdf)['\"`]"
READS = [
    "readFileSync" + _QUOTED, "readFile" + _QUOTED, "createReadStream" + _QUOTED, "read_csv" + _QUOTED, "read_excel" + _QUOTED, "read_json" + _QUOTED, "read_parquet" + _QUOTED, "read_table" + _QUOTED,
    r"open\s*\(\s*['\"`]([^'\"`]+\.(?:csv|tsv|jsonl|ndjson|json|xlsx|xls|parquet|pdf))['\"`]", "PdfReader" + _PDF, r"pdfplumber\.open" + _PDF, r"fitz\.open" + _PDF,
    r"(?i)COPY\s+\w+\s+FROM\s+['\"`]([^'\"`]+)['\"`]", r"(?i)\\copy\s+\w+\s+from\s+['\"`]([^'\"`]+)['\"`]", r"['\"`]((?:\.\.?/)?(?:[\w\-./]+/)?[\w\-]+\.(?:csv|tsv|jsonl|ndjson|xlsx|xls|parquet|pdf))['\"`]",
]
WRITES = ["writeFileSync" + _WRITTEN, "writeFile" + _WRITTEN, "to_csv" + _QUOTED, "to_excel" + _QUOTED, "to_json" + _QUOTED, "to_parquet" + _QUOTED, "createWriteStream" + _WRITTEN, r"(?i)COPY\s+\w+\s+TO\s+['\"`]([^'\"`]+)['\"`]"]
DATA_EXTENSIONS = ["csv", "tsv", "jsonl", "ndjson", "json", "xlsx", "xls", "parquet", "pdf"]


def data_references(docs: DataFrame, id: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """Data files that source text reads or writes: (doc, file_path, ref_type, confidence).

    A path counts if it has the extension of a data file or is one of the known paths (file_path), which makes it
    certain. What a text writes counts as written, though it may be read there, too. Null and empty texts name nothing.
    """
    hits = lambda patterns: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])))
    both = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), F.explode(F.array(F.struct(F.lit(0).alias("w"), hits(READS).alias("p")), F.struct(F.lit(1).alias("w"), hits(WRITES).alias("p")))).alias("s"))
    named = both.select("doc", "s.w", F.explode("s.p").alias("path")).select("doc", "w", F.replace(F.regexp_replace("path", r"^\./", ""), F.lit("\\"), F.lit("/")).alias("file_path"))
    once = named.groupBy("doc", "file_path").agg(F.max("w").alias("w"))
    is_data = F.lower(F.element_at(F.split("file_path", r"\."), -1)).isin(DATA_EXTENSIONS)
    out = once.withColumn("known", F.lit(None).cast("boolean")) if known is None else once.join(known.select("file_path").distinct().withColumn("known", F.lit(True)), "file_path", "left")
    return out.where(F.col("known") | is_data).select("doc", "file_path", F.when(F.col("w") == 1, "writes").otherwise("reads").alias("ref_type"), F.when(F.col("known"), 1.0).otherwise(0.7).alias("confidence"))


def link_data(references: DataFrame, files: DataFrame) -> DataFrame:
    """References to the files (file_path, dataset_id) of datasets: (dataset_id, doc, ref_type, confidence)."""
    return references.join(files.select("file_path", "dataset_id").distinct(), "file_path").select("dataset_id", "doc", "ref_type", "confidence").distinct()


def counts(**tables: DataFrame) -> DataFrame:
    """Rows and distinct ids of several tables (name, rows): one row per table, each by one aggregate."""
    out = None
    for name, t in tables.items():
        part = t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(t.columns[0]).alias("n_ids"), F.min(t.columns[1]).alias("first_at"), F.max(t.columns[1]).alias("last_at"))
        out = part if out is None else out.unionByName(part)
    return out
