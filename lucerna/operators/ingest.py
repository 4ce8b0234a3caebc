"""Pages to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lucerna.functions import text as X
from lucerna.functions import words as W
from lucerna.operators import index as I
from lucerna.operators import lineage, scan, segment

BUDGET, OVERLAP, LEAST = 400, 0.15, 30
TITLED_LEAST = 10
_CARRY = "\x00carry"


def page_lines(pages: DataFrame) -> DataFrame:
    """(source_file, page, pos, line, key) of every line with a key."""
    lines = pages.select("source_file", "page", F.posexplode(F.split(X.text("text"), "\n")).alias("pos", "line"))
    return lines.withColumn("key", X.line_key("line"))


def running_lines(pages: DataFrame, ratio: float = 0.4, least: int = 3) -> DataFrame:
    """A4: (source_file, key, pages) of lines on at least max(least, ratio * pages) distinct pages of a document."""
    keys = F.array_distinct(F.transform(F.split(X.text("text"), "\n"), X.line_key))
    seen = pages.select("source_file", "page", F.explode(keys).alias("key")).where("key <> ''").distinct().groupBy("source_file", "key").agg(F.count("*").alias("pages"))
    totals = pages.groupBy("source_file").agg(F.count_distinct("page").alias("_n"))
    return seen.join(I.small(totals), "source_file").where(F.col("pages") >= F.greatest(F.lit(float(least)), F.lit(ratio) * F.col("_n"))).drop("_n")


def drop_running_lines(pages: DataFrame, ratio: float = 0.4, least: int = 3) -> DataFrame:
    """The pages without their document's running lines; order kept.

    Few running lines go to the pages as an array for each document, so that a
    page's lines stay in their row; many are joined line by line.
    """
    running = lineage.cut(running_lines(pages, ratio, least).select("source_file", "key"))
    if running.limit(I.BROADCAST_ROWS + 1).count() <= I.BROADCAST_ROWS:
        held = running.groupBy("source_file").agg(F.collect_list("key").alias("_keys"))
        lines = F.split(X.text("text"), "\n")
        kept = F.array_join(F.filter(lines, lambda s: ~F.array_contains("_keys", X.line_key(s))), "\n")
        return pages.join(F.broadcast(held), "source_file", "left").withColumn("text", F.when(F.col("_keys").isNull(), X.text("text")).otherwise(kept)).drop("_keys")
    kept = page_lines(pages).join(running, ["source_file", "key"], "left_anti")
    joined = kept.groupBy("source_file", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return pages.drop("text").join(joined.select("source_file", "page", text.alias("text")), ["source_file", "page"], "left").withColumn("text", X.text("text"))


def needs_ocr(pages: DataFrame, least: int = 20) -> DataFrame:
    """S3: (source_file, needs_ocr): a document with any page of fewer than `least` characters."""
    return pages.groupBy("source_file").agg(F.bool_or(F.length(F.btrim(X.text("text"), F.lit(" \n\t\r"))) < least).alias("needs_ocr"))


def carried(rows: DataFrame, title: Column, order: list[str], by: list[str], name: str) -> DataFrame:
    """Adds the last title that is not null, in document order; a document may be of any length."""
    return scan.last_values(rows, by, order, {name: title})


# Numbered titles and titles that stand alone start a path anew.
NUMBERED_TITLE = r"^[0-9]{1,3}\.\s"
STANDALONE_TITLE = r"(?i)^(resumen (de (las )?)?recomendaciones|tarjetas? de bolsillo)"
SEPARATOR = segment.SEPARATOR


def title_paths(titles: DataFrame) -> DataFrame:
    """Adds `path` to rows (source_file, page, pos, title).

    Numbered titles and those that stand alone are the top; of "n. head: rest"
    only the head is, and the rest hangs below it. Capitals are the middle,
    until the next top; others hang below both. A document may have any number
    of titles: they are scanned by ranges.
    """
    place, title = F.struct("page", "pos"), X.clean_title("title")
    named = (title != "") & (title != W.DEFAULT_SECTION)
    alone = named & title.rlike(STANDALONE_TITLE)
    numbered = named & ~alone & title.rlike(NUMBERED_TITLE)
    upper = named & ~alone & ~numbered & X.is_upper_title(title)
    head = F.trim(F.substring_index(title, ":", 1))
    rest = F.trim(F.substring(title, F.length(F.substring_index(title, ":", 1)) + 2, F.length(title)))
    top = F.when(alone, title).when(numbered, head)
    last = {"_t": F.when(top.isNotNull(), F.struct(place.alias("at"), top.alias("title"))), "_m": F.when(upper, F.struct(place.alias("at"), title.alias("title")))}
    rows = scan.last_values(titles, ["source_file"], ["page", "pos"], last)
    middle = F.when(F.col("_t").isNull() | (F.col("_m.at") > F.col("_t.at")), F.col("_m.title"))
    below = F.when(numbered, F.nullif(rest, F.lit(""))).when(~alone & ~upper, title)
    path = F.when(~named, F.col("title")).otherwise(F.concat_ws(SEPARATOR, F.col("_t.title"), middle, below))
    return rows.withColumn("path", path).drop("_t", "_m", *([] if scan.PART in titles.columns else [scan.PART]))


def chunk_id(*parts: Column) -> Column:
    """A fixed id from what the chunk is, so that a new build gives the same ids."""
    return F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256)


def chunk_pages(pages: DataFrame, budget: int = BUDGET, overlap: float = OVERLAP, least: int = LEAST, ratio: float = 0.4, drop_tables: bool = False) -> DataFrame:
    """D3: section-aware chunks of documents (source_file, page, text).

    Running lines, cleaning, pipe tables, sections, carried titles and paths,
    bibliographies, packing, least sizes, header, index; see the blueprint's
    appendix for the order. Gives source_file, page, section, chunk_index,
    text, chunk_id.
    """
    # texts are made once, and so are sections: running lines, and the sample by which ranges are dealt out, read them too;
    # an inner explode, or a filter on what was made, would make both anew, so emptiness is looked at behind them
    pages = lineage.cut(pages.select("source_file", "page", "text"))
    clean = X.clean_page("text")
    if drop_tables:
        clean = X.strip_tables(clean)
    cut = X.bind(clean, lambda x: F.when(x != "", segment.sections(x, _CARRY, True)))
    parts = lineage.cut(drop_running_lines(pages, ratio).select("source_file", "page", F.inline_outer(cut))).where("pos IS NOT NULL")
    # one deal of the sections by document, page and place serves titles, carried titles and numbers
    parts = scan.placed(parts.withColumn("title", F.when(F.col("title") != _CARRY, F.col("title"))), ["source_file"], ["page", "pos"])
    parts = title_paths(parts)
    shown = F.when(X.is_bibliography_title("title"), F.col("title")).otherwise(F.col("path"))
    parts = carried(parts, F.when(F.col("title").isNotNull(), shown), ["page", "pos"], ["source_file"], "section")
    parts = parts.withColumn("section", F.coalesce(F.nullif(X.clean_title("section"), F.lit("")), F.lit(W.DEFAULT_SECTION)))
    parts = parts.where((F.trim("body") != "") & ~X.is_bibliography_title("section"))
    pieces = parts.select(scan.PART, "source_file", "page", "pos", "section", F.posexplode_outer(segment.split_long("body", budget, overlap, 1)).alias("piece", "body"))
    titled = F.col("section") != W.DEFAULT_SECTION
    pieces = pieces.where((X.approx_tokens("body") >= F.when(titled, min(least, TITLED_LEAST)).otherwise(least)) & ~X.is_bibliography("body"))
    # the texts are made once, for the counts of the ranges and for the rows
    pieces = scan.numbers(lineage.cut(pieces), ["source_file"], ["page", "pos", "piece"], "chunk_index")
    out = pieces.select("source_file", "page", "section", F.col("chunk_index").cast("int").alias("chunk_index"), X.with_header(F.col("section"), F.col("body"), W.DEFAULT_SECTION).alias("text"))
    return out.withColumn("chunk_id", chunk_id(F.col("source_file"), F.col("chunk_index"), F.col("text")))


def table_rows(tables: DataFrame) -> DataFrame:
    """One chunk per row of curated tables.

    `tables`: source_file, title, page, general_notes array<string>, rows
    array<struct<cells array<struct<col, val>>, notes array<string>>>.
    """
    rows = tables.select("source_file", "title", "page", "general_notes", F.posexplode("rows").alias("row_index", "row"))
    filled = F.filter(F.col("row.cells"), lambda c: F.trim(X.text(c["val"])) != "")
    first = F.regexp_replace(F.get(filled, 0)["val"], r"\*+$", "")
    heading = F.concat_ws(" — ", F.col("title"), F.trim(first))
    body = F.transform(filled, lambda c: F.concat(c["col"], F.lit(": "), F.trim(c["val"])))
    notes = F.concat(F.coalesce(F.col("row.notes"), F.array().cast("array<string>")), F.coalesce(F.col("general_notes"), F.array().cast("array<string>")))
    text = F.concat(heading, F.lit(".\n"), F.array_join(F.concat(body, notes), "\n"))
    return rows.select("source_file", "page", heading.alias("section"), "row_index", text.alias("text"))


def append_rows(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Table rows after a document's text chunks, the index going on."""
    last = chunks.groupBy("source_file").agg((F.max("chunk_index") + 1).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("source_file").orderBy("section", "row_index")) - 1
    added = rows.withColumn("_n", nth).join(last, "source_file", "left").withColumn("chunk_index", F.coalesce("_base", F.lit(0)) + F.col("_n"))
    added = added.withColumn("chunk_id", chunk_id(F.col("source_file"), F.col("chunk_index"), F.col("text")))
    return chunks.unionByName(added.select(*chunks.columns))


def tagged(chunks: DataFrame, catalog: DataFrame, strict: bool = True) -> DataFrame:
    """source_type and source_title from the catalog (file, source_type, title) by normalised name.

    With `strict` a file that the catalog lacks is an error when rows are read.
    """
    known = I.small(catalog.select(X.plain_key("file").alias("_key"), "source_type", F.coalesce("title", "file").alias("source_title")))
    rows = chunks.join(known, X.plain_key("source_file") == F.col("_key"), "left").drop("_key")
    if strict:
        missing = F.raise_error(F.concat(F.lit("not in the catalog: "), F.col("source_file"))).cast("string")
        rows = rows.withColumn("source_type", F.coalesce("source_type", missing))
    return rows


def by_kind(chunks: DataFrame) -> DataFrame:
    """How many chunks are the house's own and how many are from outside."""
    own = F.col("source_type") == "institucional"
    return chunks.agg(F.count_if(own).alias("own"), F.count_if(~own).alias("outside"))


def valid_tables(tables: DataFrame) -> DataFrame:
    """Errors for tables that are not reviewed, have no rows, or name another document (`document` and `source_file`)."""
    wrong = F.when(X.plain_key("document") != X.plain_key("source_file"), "table of another document").when(~F.coalesce("reviewed", F.lit(False)), "table not reviewed").when(F.coalesce(F.size("rows"), F.lit(0)) < 1, "table without rows")
    return tables.where(F.assert_true(wrong.isNull(), F.coalesce(wrong, F.lit(""))).isNull())


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def with_defaults(payload: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns and nulls get their defaults."""
    return payload.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in payload.columns else F.lit(v) for c, v in defaults.items()})


def html_text(html: Column) -> Column:
    """Text of a web page: headings as markdown, list items as bullets, boilerplate blocks and tags gone."""
    x = F.regexp_replace(X.text(html), r"(?is)<(script|style|nav|footer|header|head)\b.*?</\1>", " ")
    for level in range(1, 7):
        x = F.regexp_replace(x, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    x = F.regexp_replace(x, r"(?is)<li\b[^>]*>", "\n- ")
    x = F.regexp_replace(x, r"(?is)<(p|div|br|ul|ol|tr|table|section|article)\b[^>]*>|</(p|div|ul|ol|tr|table)>", "\n\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    x = F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*\n\s*", "\n\n"), F.lit(" \n"))
