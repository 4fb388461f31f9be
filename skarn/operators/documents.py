"""Documents as trees of sections, references to code, wiki pages and their lint."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def lines_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line_no, line) of every line, with its offset in bytes."""
    at = F.posexplode(F.split(text, "\n"))
    return docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc_id"), at.alias("line_no", "line"))


def _sections(text: str | None) -> Iterator[dict]:
    """Markdown sections of one text: ATX and setext headings outside of fences, with byte ranges and a parent stack."""
    if not text:
        return
    import re

    found, offset, fence = [], 0, None
    lines = text.split("\n")
    for i, line in enumerate(lines):
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if mark and (fence is None or mark[1][0] == fence):
            fence = None if fence else mark[1][0]
        elif fence is None:
            m = re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
            if m and m[2]:
                found.append((offset, len(m[1]), m[2]))
            elif i + 1 < len(lines) and line.strip() and re.fullmatch(r"\s{0,3}(=+|-{2,})\s*", lines[i + 1]) and not line.startswith(("#", "-", ">", "|", "    ")):
                found.append((offset, 1 if "=" in lines[i + 1] else 2, line.strip()))
        offset += len(line.encode()) + 1
    end = len(text.encode())
    stack: list[tuple[int, str]] = []
    for k, (start, level, title) in enumerate(found):
        while stack and stack[-1][0] >= level:
            stack.pop()
        yield {"position": k, "level": level, "title": title, "ancestors": [t for _, t in stack], "byte_start": start, "byte_end": found[k + 1][0] if k + 1 < len(found) else end}
        stack.append((level, title))


SECTIONS = "doc_id string, position int, level int, title string, ancestors array<string>, byte_start bigint, byte_end bigint"


def markdown_sections(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Sections of Markdown texts; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.string()), ("position", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("ancestors", pa.list_(pa.string())), ("byte_start", pa.int64()), ("byte_end", pa.int64())]
        for b in batches:
            rows = [{"doc_id": k, **s} for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in _sections(t)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    return docs.select(F.col(id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SECTIONS)


def toc(sections: DataFrame) -> DataFrame:
    """Titles in order with an indent by level."""
    return sections.select("file_path", "position", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), "title").alias("entry"))


def candidate_references(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, name): names in backticks and identifiers that may point to symbols."""
    from skarn.functions.text import backticked, identifiers

    ticks = F.transform(backticked(F.col(text)), lambda x: F.regexp_replace(x, r"\(.*\)$", ""))
    names = F.filter(F.array_union(ticks, identifiers(F.col(text))), lambda x: F.length(x) >= 3)
    return docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), F.explode(names).alias("name")).distinct()


def resolve_references(refs: DataFrame, nodes: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Names to qualified names of symbols: (doc, qualified_name, confidence). A symbol's last name part counts, too."""
    named = nodes.where("name is not null and qualified_name is not null").select(F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))).alias("name"), "qualified_name").distinct()
    return refs.join(named, "name").select("doc", "qualified_name", F.lit(confidence).alias("confidence")).distinct()


def refs_by_section(refs: DataFrame) -> DataFrame:
    best = F.max(F.struct("confidence", "created_at"))
    return refs.where("section_id is not null and qualified_name is not null").groupBy("section_id", "qualified_name", "ref_type").agg(best.alias("m")).select("section_id", "qualified_name", "ref_type", "m.confidence")


def broken_parents(sections: DataFrame) -> DataFrame:
    """Current sections whose parent is no section."""
    from skarn.operators.hierarchy import links_of

    cur = links_of(sections, "id", "parent_id", "updated_at")
    return cur.where("parent_id is not null").join(cur.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


def wiki_links(pages: DataFrame, slug: str, content: str) -> DataFrame:
    """(slug, target): pages that a page names as [[target]]."""
    found = F.regexp_extract_all(F.col(content), F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
    return pages.select(F.col(slug).alias("slug"), F.explode(found).alias("target")).select("slug", F.trim(F.lower("target")).alias("target")).distinct()


def wiki_lint(pages: DataFrame, slug: str, content: str) -> DataFrame:
    """(slug, finding): links to no page, and pages that no page links to."""
    links = wiki_links(pages, slug, content)
    known = pages.select(F.col(slug).alias("target")).distinct()
    broken = links.join(known, "target", "left_anti").select("slug", F.concat(F.lit("broken "), "target").alias("finding"))
    orphan = pages.select(F.col(slug).alias("slug")).distinct().join(links.where("slug <> target").select(F.col("target").alias("slug")), "slug", "left_anti").withColumn("finding", F.lit("orphan"))
    return broken.unionByName(orphan)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; ``count`` names a column that adds up instead."""
    if not count:
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys and c != count]
    g = both.groupBy(*keys).agg(F.max(F.struct("__new", *rest)).alias("m"), F.sum(count).alias(count))
    return g.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest], count).select(*old.columns)


def section_context(sections: DataFrame) -> DataFrame:
    """Per current section its title, the titles of its ancestors from the root, and its number of children."""
    from skarn.operators.hierarchy import build
    from skarn.skew import current_rows

    h = build(sections)
    cur = current_rows(sections.select("id", "title", "updated_at"), ["id"], "updated_at").select("id", "title")
    named = h.descendants().join(cur.withColumnsRenamed({"id": "ancestor_id", "title": "above"}), "ancestor_id")
    chain = named.groupBy(F.col("descendant_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "above"))).alias("c"))
    children = h.reached.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    out = h.reached.select("id").join(cur, "id").join(chain, "id", "left").join(children, "id", "left")
    return out.select("id", "title", F.coalesce(F.array_join("c.above", " > "), F.lit("")).alias("ancestors"), F.coalesce("children", F.lit(0)).alias("children"))


def apply_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages (slug, content) after edit blocks (slug, seq, action, body) in order: create and replace set the content,
    append adds a paragraph. Blocks of one page are folded in order; pages without blocks stay."""
    ops = blocks.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "body"))).alias("ops"))
    both = pages.join(ops, "slug", "full_outer")
    step = lambda acc, o: F.when(o.action == "append", F.concat(F.coalesce(acc, F.lit("")), F.when(acc.isNull() | (acc == ""), F.lit("")).otherwise(F.lit("\n\n")), o.body)).otherwise(o.body)
    folded = F.aggregate(F.coalesce("ops", F.array().cast("array<struct<seq: bigint, action: string, body: string>>")), F.col("content"), step)
    return both.select("slug", folded.alias("content"))


# -- lint of documents ----------------------------------------------------------------------------------------------
def docs_lint(sections: DataFrame, refs: DataFrame, nodes: DataFrame, contents: DataFrame | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """(check, subject, detail): broken refs (no such symbol), orphan refs (no such section), stale sections and sections
    that the index lacks or has in excess.

    contents: (file_path, text) as the files are now; a section is stale if its file is gone or the hash of its bytes is
    another. indexed: (id) of the sections in the text index. Only current sections count.
    """
    from skarn.skew import current_rows

    cur = current_rows(sections.select("id", "file_path", "byte_start", "byte_end", "content_hash", "updated_at"), ["id"], "updated_at")
    named = refs.where("qualified_name is not null and section_id is not null").select("section_id", "qualified_name").distinct()
    broken = named.join(nodes.select("qualified_name").distinct(), "qualified_name", "left_anti").select(F.lit("broken ref").alias("check"), F.col("section_id").alias("subject"), F.col("qualified_name").alias("detail"))
    orphan = named.join(cur.select(F.col("id").alias("section_id")), "section_id", "left_anti").select(F.lit("orphan ref").alias("check"), F.col("section_id").alias("subject"), F.col("qualified_name").alias("detail"))
    out = broken.unionByName(orphan)
    if contents is not None:
        now = cur.join(contents.select("file_path", "text"), "file_path", "left")
        part = F.substring(F.encode("text", "UTF-8"), F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int"))
        stale = now.where(F.col("text").isNull() | ~F.sha2(part, 256).eqNullSafe(F.col("content_hash")))
        out = out.unionByName(stale.select(F.lit("stale section").alias("check"), F.col("id").alias("subject"), F.col("file_path").alias("detail")))
    if indexed is not None:
        sides = cur.select("id", F.lit(1).alias("n")).unionByName(indexed.select("id", F.lit(-1).alias("n"))).groupBy("id").agg(F.sum("n").alias("n")).where("n <> 0")
        out = out.unionByName(sides.select(F.lit("index").alias("check"), F.col("id").alias("subject"), F.when(F.col("n") > 0, "missing").otherwise("in excess").alias("detail")))
    return out


# -- wiki pages from blocks -----------------------------------------------------------------------------------------
def parse_blocks(texts: DataFrame, id: str, text: str) -> DataFrame:
    """Edit blocks in texts: (doc, seq, action, page, title, section, mode, body). A block begins with a line of JSON; one
    without a second line or with broken JSON is none. seq is the block's place in its text."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)WIKI_DIFF_START\n(.*?)\nWIKI_DIFF_END"), F.lit(1))
    b = texts.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), F.posexplode(found).alias("seq", "raw")).withColumn("raw", F.regexp_replace("raw", r"\A\s+|\s+\z", ""))
    head = F.from_json(F.trim(F.substring_index("raw", "\n", 1)), "struct<action: string, page: string, title: string, section: string, mode: string>")
    body = F.substring(F.col("raw"), F.instr("raw", F.lit("\n")) + 1, F.length("raw"))
    rows = b.where(F.col("raw").contains("\n") & F.try_parse_json(F.trim(F.substring_index("raw", "\n", 1))).isNotNull()).select("doc", "seq", head.alias("h"), body.alias("body"))
    return rows.select("doc", "seq", F.coalesce("h.action", F.lit("upsert")).alias("action"), F.coalesce("h.page", F.lit("")).alias("page"), "h.title", "h.section", F.coalesce("h.mode", F.lit("append")).alias("mode"), "body")


def parse_conflicts(texts: DataFrame, id: str, text: str) -> DataFrame:
    """Conflicts in texts, a line of JSON each: (doc, page, section, existing, incoming, source, existing_date, incoming_date)."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)WIKI_DIFF_CONFLICTS\n(.*?)\nWIKI_DIFF_CONFLICTS_END"), F.lit(1))
    lines = texts.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), F.explode(found).alias("raw")).select("doc", F.explode(F.split("raw", "\n")).alias("line")).withColumn("line", F.trim("line"))
    c = F.from_json("line", "struct<page: string, section: string, existing: string, incoming: string, source: string, existingDate: string, incomingDate: string>")
    rows = lines.where(F.try_parse_json("line").isNotNull() & (F.col("line") != "")).select("doc", c.alias("c"))
    return rows.select("doc", *[F.coalesce(f"c.{x}", F.lit("")).alias(x) for x in ("page", "section", "existing", "incoming", "source")], F.col("c.existingDate").alias("existing_date"), F.col("c.incomingDate").alias("incoming_date"))


def _end(c):
    return F.regexp_replace(c, r"\s+\z", "")


def put_section(content, section, body, mode):
    """A page with a section of level two replaced or extended; a section that isn't there comes at the end."""
    heading = F.concat(F.lit("## "), section)
    at = F.instr(content, heading)
    start = at + F.length(heading)
    rest = F.substring(content, start, F.length(content))
    stop = F.instr(rest, F.lit("\n## "))
    inner = F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)
    after = F.when(stop > 0, F.substring(rest, stop, F.length(rest))).otherwise("")
    before = F.substring(content, F.lit(1), at - 1)
    new = F.concat(_end(body), F.lit("\n"))
    put = F.when(mode == "replace", F.concat(before, heading, F.lit("\n"), new, after)).otherwise(F.concat(before, heading, _end(inner), F.lit("\n"), new, after))
    return F.when(at == 0, F.concat(_end(content), F.lit("\n\n"), heading, F.lit("\n"), new)).otherwise(put)


def apply_page_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages (slug, title, content, source_count) after the blocks of :func:`parse_blocks`, in the order of (doc, seq).

    create sets title and content; upsert puts a section, or a paragraph where it names none; append adds a paragraph. A
    page that isn't there begins with its name as heading. Each block adds one to the page's sources. Blocks of one page
    are folded in order; pages without blocks stay. Blocks without a page are left out.
    """
    ops = blocks.where("page <> ''").groupBy(F.col("page").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("doc", "seq", "action", "title", "section", "mode", "body"))).alias("ops"))
    both = pages.select("slug", "title", "content", "source_count").join(ops, "slug", "full_outer")
    empty = F.concat(F.lit("# "), "slug", F.lit("\n\n"))

    def step(acc, o):
        now = F.coalesce(acc, empty)
        created = F.concat(F.lit("# "), F.coalesce(o.title, F.col("slug")), F.lit("\n\n"), _end(o.body), F.lit("\n"))
        added = F.concat(_end(now), F.lit("\n\n"), _end(o.body), F.lit("\n"))
        return F.when(o.action == "create", created).when((o.action == "upsert") & o.section.isNotNull(), put_section(now, o.section, o.body, o.mode)).when(o.action.isin("upsert", "append"), added).otherwise(acc)

    known = F.coalesce("ops", F.array().cast(both.schema["ops"].dataType))
    content = F.aggregate(known, F.col("content"), step)
    title = F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1)
    out = both.select("slug", "title", content.alias("content"), (F.coalesce("source_count", F.lit(0)) + F.size(known)).cast("bigint").alias("source_count"), (F.size(known) > 0).alias("touched"))
    return out.select("slug", F.when(F.col("touched") | F.col("title").isNull(), F.coalesce(F.nullif(title, F.lit("")), F.col("slug"))).otherwise(F.col("title")).alias("title"), "content", "source_count")


def resolve_conflicts(pages: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conflicts settled by date: (page, section, resolved, content). The incoming claim replaces the existing one, with a
    note, if it isn't older and page and section are named; content is the page after it, null where nothing is settled."""
    day = lambda c: F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.col(c))), F.lit(0))
    j = conflicts.join(pages.select(F.col("slug").alias("page"), "content"), "page", "left")
    done = (day("incoming_date") >= day("existing_date")) & (F.col("section") != "") & F.col("content").isNotNull()
    note = F.concat(F.lit("\n> ⚠ Superseded by "), "source", F.lit(" on "), F.coalesce("incoming_date", F.lit("unknown date")), F.lit("\n"))
    at = F.instr("content", F.col("existing"))
    put = F.when((at > 0) & (F.col("existing") != ""), F.concat(F.substring(F.col("content"), F.lit(1), at - 1), "incoming", note, F.substring(F.col("content"), at + F.length("existing"), F.length("content")))).otherwise(F.col("content"))
    return j.select("page", "section", done.alias("resolved"), F.when(done, put).alias("content"))


def manifest(pages: DataFrame) -> DataFrame:
    """A line per page of the wiki's listing: (slug, line)."""
    return pages.select("slug", F.format_string("| [%s](%s) | %s | %d | %s |", "slug", "file_path", "title", "source_count", F.date_format(F.timestamp_millis("updated_at"), "yyyy-MM-dd")).alias("line"))


def reindex_pages(files: DataFrame) -> DataFrame:
    """Pages from Markdown files (path, content): (slug, title, content). Listing and schema are no pages."""
    slug = F.regexp_replace("path", r"^.*/wiki/|\.md$", "")
    title = F.nullif(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1), F.lit(""))
    return files.where(F.col("path").endswith(".md") & ~F.col("path").rlike(r"(?:^|/)(?:MANIFEST|SCHEMA)\.md$")).select(slug.alias("slug"), F.coalesce(title, slug).alias("title"), "content")


def wiki_review(pages: DataFrame, slug: str = "slug", content: str = "content") -> DataFrame:
    """(slug, finding) of pages beyond their links: a list of sources without any date is stale."""
    sources = F.regexp_extract(content, r"(?s)## Sources\n(.*?)(?:\n## |\n*\z)", 1)
    has = F.col(content).contains("## Sources\n")
    return pages.where(has & ~sources.rlike(r"\d{4}-\d{2}-\d{2}")).select(F.col(slug).alias("slug"), F.lit("stale").alias("finding"))


# What a page says where it contradicts another.
NEGATIONS = ("instead of", "not", "replaced by", "superseded", "deprecated")


#: Pages of one class, about, that lie in one row while pairs are made.
CLASS_BLOCK = 512


def contradictions(pages: DataFrame, slug: str = "slug", title: str = "title", content: str = "content") -> DataFrame:
    """Pairs of pages one of which holds every word of the other's title, that both hold the same mark of negation:
    (a, b, signal), a < b, signal the first such mark. A title is joined by its rarest word, the others are checked.

    Pages with the same words, title words and marks are one class. Classes are matched, each pair from one side only; their
    pages, in blocks, are paired last of all, so that pairs of pages are neither shuffled nor sorted. Only pairs with a slug
    whose rows are of several classes are made unique, with their least mark.
    """
    from skarn.operators.search import tokens
    from skarn.session import cut, parallelism
    from skarn.skew import salted_join

    signals = F.array_compact(F.array(*[F.when(F.lower(content).contains(s), F.lit(s)) for s in NEGATIONS]))
    words = lambda c: F.array_sort(F.array_distinct(tokens(c)))
    what = ["ts", "ask", "sig"]
    p = pages.select(F.col(slug).alias("slug"), words(F.concat_ws(" ", title, content)).alias("ts"), words(F.coalesce(title, F.lit(""))).alias("ask"), signals.alias("sig"))
    p = p.where((F.size("sig") > 0) & F.col("slug").isNotNull()).withColumn("class", F.unhex(F.sha2(F.to_json(F.struct(*what)), 256)))
    classes = cut(p.groupBy("class").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in what]), "classes")
    members = p.select("slug", "class").distinct().join(classes.select("class", "n"), "class")

    df = classes.select("n", F.explode("ts").alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    rare = salted_join(classes.select("class", F.explode("ask").alias("term")), df, "term", "inner").groupBy("class").agg(F.min(F.struct("df", "term")).alias("r"))
    askers = classes.select("class", *what).join(rare, "class").select(F.col("class").alias("x"), *[F.col(c).alias(f"{c}_x") for c in what], F.col("r.term").alias("term"))
    hits = askers.join(classes.select(F.col("class").alias("y"), *what, F.explode("ts").alias("term")), "term")
    both = F.array_intersect("sig_x", "sig")
    back = (F.size("ask") > 0) & (F.size(F.array_except("ask", "ts_x")) == 0)
    links = hits.where((F.size(both) > 0) & (F.size(F.array_except("ask_x", "ts")) == 0) & ((F.col("x") <= F.col("y")) | ~back)).select("x", "y", both[0].alias("signal"))

    several = cut(members.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slug", F.lit(True).alias("several")), "several")
    block = F.pmod(F.xxhash64("slug"), F.ceil(F.col("n") / CLASS_BLOCK))
    blocks = members.join(several, "slug", "left").groupBy("class", F.coalesce("several", F.lit(False)).alias("several"), block.alias("block")).agg(F.collect_list("slug").alias("slugs"))
    blocks = cut(blocks, "blocks")
    one, two = (blocks.select(F.col("class").alias(c), F.struct("several", "block").alias(f"at_{c}"), F.col("slugs").alias(f"slugs_{c}")) for c in "xy")
    met = links.join(one, "x").join(two, "y").where((F.col("x") != F.col("y")) | (F.col("at_x") <= F.col("at_y")))
    met = met.repartition(4 * parallelism(pages.sparkSession), "x", "y", "at_x", "at_y").withColumn("same", (F.col("x") == F.col("y")) & (F.col("at_x") == F.col("at_y")))

    def pairs(rows: DataFrame) -> DataFrame:
        each = rows.select(F.explode("slugs_x").alias("p"), "slugs_y", "same", "signal").select("p", F.explode("slugs_y").alias("q"), "same", "signal")
        return each.where(F.when(F.col("same"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "signal")

    if several.isEmpty():
        return pairs(met)
    apart = F.col("at_x.several") | F.col("at_y.several")
    return pairs(met.where(~apart)).unionByName(pairs(met.where(apart)).groupBy("a", "b").agg(F.min("signal").alias("signal")))


def context_pages(hits: DataFrame, n: int = 3, floor: float = 0.4) -> DataFrame:
    """The best pages (doc, score) for a context: at most ``n``, of a score of at least ``floor``."""
    return hits.where(F.col("score") >= floor).orderBy(F.desc("score"), "doc").limit(n)


def path_links(refs: DataFrame, sections: DataFrame, names: DataFrame, floor: float = 0.5, n: int | None = None) -> DataFrame:
    """Sections that name the symbols of a context (qualified_name): (section_id, file_path, title, confidence), each section
    once with its greatest confidence."""
    best = refs.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").where(F.col("confidence") >= floor).groupBy("section_id").agg(F.max("confidence").alias("confidence"))
    from skarn.skew import current_rows

    cur = current_rows(sections.select("id", "file_path", "title", "updated_at"), ["id"], "updated_at").select(F.col("id").alias("section_id"), "file_path", "title")
    out = best.join(cur, "section_id").select("section_id", "file_path", "title", "confidence")
    return out.orderBy(F.desc("confidence"), "section_id").limit(n) if n else out


def refs_both_ways(refs: DataFrame, names: DataFrame) -> DataFrame:
    """References of symbols (qualified_name), by descending confidence within one: (qualified_name, section_id, ref_type, confidence)."""
    best = refs_by_section(refs)
    return best.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").select("qualified_name", "section_id", "ref_type", "confidence")


def tree(sections: DataFrame) -> DataFrame:
    """The current sections in the order of a walk from the roots, children by position: (id, depth, place). place sorts
    as the walk goes: the positions from the root down, padded."""
    from skarn.operators.hierarchy import build
    from skarn.skew import current_rows

    h = build(sections)
    pos = current_rows(sections.select("id", "position", "updated_at"), ["id"], "updated_at").select("id", F.concat(F.lpad(F.coalesce("position", F.lit(0)).cast("string"), 10, "0"), F.lit(":"), "id").alias("key"))
    steps = h.reached.select("id", "depth", F.posexplode("path").alias("i", "step")).join(pos.withColumnRenamed("id", "step"), "step")
    return steps.groupBy("id", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "key"))), lambda x: x.key), "/").alias("place"))
