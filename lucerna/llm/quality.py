"""Quality rules with thresholds taken from the corpus (operator 5)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lucerna.llm import common, vec

#: The characters of n_symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Relative error of the quantile sketch.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
SMALLEST = 1e-4
#: Upper and lower fences lie this many spreads (third less first quartile) outside the quartiles.
FENCE = 4.0
#: For each measure: the least spread that counts, and whether low values are rejected too.
MEASURES = {"word_length": (0.5, True), "symbols": (0.05, False), "dup_lines": (0.1, False), "repeats": (0.08, False)}
#: Rows that the quartiles of a language count for beside those of its source, and those of all rows beside those of a language.
PRIOR_ROWS = 200
#: Groups up to which the thresholds are broadcast (under 10 MB); beyond it they are joined by shuffle.
BROADCAST_GROUPS = 50_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every row of a batch, as in `features`."""
    n_rows = len(offsets) - 1
    starts, ends, first = vec.word_spans(data, offsets)
    hashes = vec.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = vec.row_sums(vec.code_points(data, starts, ends), first)
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    cuts = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    line_row = np.searchsorted(offsets[:-1], line_start, side="right") - 1
    # a line break at the end of a row opens an empty last line whose start equals the next row's; it has no word
    line_end = np.sort(np.concatenate([cuts, offsets[1:]]), kind="stable")
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    at = np.searchsorted(line_row, np.arange(n_rows + 1))
    distinct = vec.unique_by_row(vec.span_hashes(data, line_start, line_end), at)[1] if len(line_start) else at
    out["n_lines"] = np.diff(at)
    out["n_dup_lines"] = np.diff(at) - np.diff(distinct)

    out["n_repeat_words"] = np.zeros(n_rows, np.int64)
    if len(hashes) >= 3:
        row = vec.rows_of(first)
        window = np.flatnonzero(row[2:] == row[:-2])
        h = vec.mix(hashes[window]) * np.uint64(3) + vec.mix(hashes[window + 1] + np.uint64(1)) * np.uint64(5) + vec.mix(hashes[window + 2] + np.uint64(2)) * np.uint64(7)
        r = row[window]
        order = np.lexsort((h, r))
        hs, rs = h[order], r[order]
        same = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
        twice = np.zeros(len(hs), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = window[order[twice]]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[hit + k] = True
        out["n_repeat_words"] = vec.row_sums(covered.astype(np.int64), first)
    return out


def with_counts(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows with their counts in a struct column `counts`; `carry` names the columns to keep, in a struct `row`."""
    common.bounded(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    shape = ", ".join(f"{c}: bigint" for c in COUNTS)

    def run(batches):
        for part, data, offsets in vec.text_slices(batches):
            counts = text_counts(data, offsets)
            struct = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([part.column("row"), struct], ["row", "counts"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, counts struct<{shape}>")


def measures(counts: str = "counts") -> dict[str, Column]:
    """The measures of a text; NULL for a text without words."""
    c = lambda name: F.col(f"{counts}.{name}")
    words = F.nullif(c("n_words"), F.lit(0))
    return {
        "word_length": c("word_chars") / words,
        "symbols": c("n_symbols") / words,
        "dup_lines": c("n_dup_lines") / F.nullif(c("n_lines"), F.lit(0)),
        "repeats": c("n_repeat_words") / words,
    }


def sketch(rows: DataFrame) -> DataFrame:
    """Quantile sketches: (lang, source, measure, bucket, n).

    Bucket b holds the values in (GAMMA^(b-1), GAMMA^b], so a quantile read
    from it is within ALPHA of the true one; sketches merge by adding counts.
    A task passes on one row per group, measure and bucket.
    """
    each = F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures().items()))
    flat = rows.select("lang", "source", F.inline(each)).where("value IS NOT NULL")
    bucket = F.when(F.col("value") <= SMALLEST, F.lit(None)).otherwise(F.ceil(F.log("value") / F.lit(math.log(GAMMA))))
    return flat.groupBy("lang", "source", "measure", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, measure columns low_* and high_*) from merged sketches.

    The quartiles of a group are means of its own, weighted by its rows, and of
    its language's, those of the language likewise of its own and of all rows',
    so that a group's size changes nothing by a jump.
    """
    value = F.coalesce(F.lit(2 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), F.col("bucket")), F.lit(0.0))

    def fences(groups: list[str]) -> DataFrame:
        merged = sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*groups, "measure")
        seen = merged.withColumn("upto", F.sum("n").over(w.orderBy(F.asc_nulls_first("bucket")))).withColumn("total", F.sum("n").over(w))
        q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), value))
        return seen.groupBy(*groups, "measure").agg(q(0.25).alias("q1"), q(0.75).alias("q3"), F.max("total").alias("total"))

    pair = fences(["lang", "source"])
    lang, whole = fences(["lang"]), fences([])
    joined = pair.alias("p").join(lang.alias("l"), F.col("p.lang").eqNullSafe(F.col("l.lang")) & (F.col("p.measure") == F.col("l.measure"))).join(whole.alias("w"), F.col("p.measure") == F.col("w.measure"))

    def chosen(c: str) -> Column:
        of_lang = (F.col("l.total") * F.col(f"l.{c}") + PRIOR_ROWS * F.col(f"w.{c}")) / (F.col("l.total") + PRIOR_ROWS)
        return ((F.col("p.total") * F.col(f"p.{c}") + PRIOR_ROWS * of_lang) / (F.col("p.total") + PRIOR_ROWS)).alias(c)

    quartiles = joined.select("p.lang", "p.source", "p.measure", chosen("q1"), chosen("q3"))
    out = []
    for name, (least, both) in MEASURES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        mine = F.col("measure") == name
        out.append(F.max(F.when(mine, F.col("q3") + FENCE * spread)).alias(f"high_{name}"))
        if both:
            out.append(F.max(F.when(mine, F.col("q1") - FENCE * spread)).alias(f"low_{name}"))
    return quartiles.groupBy("lang", "source").agg(*out)


def base_failed(counts: str = "counts") -> Column:
    words = F.col(f"{counts}.n_words")
    return (words < MIN_WORDS) | (100 * F.col(f"{counts}.n_repeat_words") > MAX_REPEAT_PERCENT * words)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows with lang, source and counts."""
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(c for c in limits.columns if c not in ("lang", "source")))
    if limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    out = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    inside = F.lit(True)
    for name, value in measures().items():
        inside &= value <= F.col(f"high_{name}")
        if MEASURES[name][1]:
            inside &= value >= F.col(f"low_{name}")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def _grouping(docs: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast("string").alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict of every text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept. A text is kept if it has MIN_WORDS
    words, at most MAX_REPEAT_PERCENT of them in repeated 3-word windows, and
    if its mean word length, symbols a word, share of repeated lines and share
    of repeated words lie inside fences around the quartiles of its language
    and source. A null text has no words and is not kept; a null language or
    source is a group of its own; a missing column counts as null. Equal and
    null ids stay apart. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *_grouping(docs, lang_col, source_col))
    counted = common.stored(with_counts(rows, "text", ["doc_id", "lang", "source"]).select("row.*", "counts"), "quality")
    limits = common.stored(thresholds(sketch(counted)), "quality-limits")
    return judged(counted, limits).select("doc_id", *(f"counts.{c}" for c in COUNTS[:5]), "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that `quality` keeps, with all their columns.

    Null texts go; a null or missing language or source is a group of its own;
    repeated rows stay or go together. Columns may have any names. An empty
    table gives an empty result.
    """
    own = docs.select(F.col(f"`{text_col}`").alias("text"), *_grouping(docs, lang_col, source_col))
    limits = common.stored(thresholds(sketch(with_counts(own, "text", ["lang", "source"]).select("row.*", "counts"))), "quality-limits")
    rows = with_counts(docs, text_col).select("row", "counts", *(c.alias(n) for c, n in zip(_grouping_of_row(docs, lang_col, source_col), ("lang", "source"))))
    return judged(rows, limits).where("kept").select("row.*")


def _grouping_of_row(docs: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [(F.col("row")[c] if c in docs.columns else F.lit(None)).cast("string") for c in (lang_col, source_col)]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"))
