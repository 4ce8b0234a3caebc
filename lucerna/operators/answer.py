"""Extractive answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lucerna.functions import text as X
from lucerna.functions import words as W
from lucerna.operators import segment
from lucerna.operators.retrieve import INSTITUTIONAL


# The mark of a translated unit, and the id that a translator may repeat before a text.
TRANSLATED = "(traducido del inglés)"
LEADING_ID = r"(?iU)^\s*u[0-9]+\s*[:.-]\s*"


def merge_continuations(rows: DataFrame) -> DataFrame:
    """Consecutive chunks of a section as one row: best score, texts joined in order, at the place of its best-ranked part.

    Rows: qid, rank, source_file, section, chunk_index, text, score, and any others, taken from that part.
    """
    place = Window.partitionBy("qid", "source_file", "section").orderBy("chunk_index")
    island = F.col("chunk_index") - F.row_number().over(place)
    marked = rows.withColumn("_island", island)
    others = [c for c in rows.columns if c not in ("qid", "source_file", "section", "text", "score", "rank")]
    merged = marked.groupBy("qid", "source_file", "section", "_island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
        F.max("score").alias("score"),
        F.min(F.struct("rank", *others)).alias("_first"),
    )
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("_first.rank"))
    return merged.select("qid", "source_file", "section", "text", "score", *(F.col(f"_first.{c}").alias(c) for c in others), nth.alias("rank"))


def relevance_gate(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """Only questions whose best score reaches `least`."""
    return rows.withColumn("_best", F.max("score").over(Window.partitionBy("qid"))).where(F.col("_best") >= least).drop("_best")


def once(rows: DataFrame, by: list[str], text: str, order: list[str]) -> DataFrame:
    """Of rows whose text is the same but for case, the first."""
    nth = F.row_number().over(Window.partitionBy(*by, F.lower(text)).orderBy(*order))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def build_units(rows: DataFrame) -> DataFrame:
    """(qid, uid, unit, rank, ord, and the chunk's columns): units of all chunks, tidied if from outside, each text once, numbered u1..."""
    cut = rows.select("*", F.posexplode(segment.units("text", "section")).alias("ord", "unit"))
    outside = F.col("source_type") != INSTITUTIONAL

    def usable(u: Column) -> Column:
        return F.when((u != "") & ~(outside & (X.is_study_summary(u) | X.unusable_external(u))), u)

    # every step reads its input more than once, so each is bound: the optimizer would multiply columns
    steps = [(X.tidy_external, outside), (X.strip_references, F.lit(True)), (X.trim_tail, outside)]
    unit = reduce(lambda u, s: segment.bind(u, lambda v: F.when(s[1], s[0](v)).otherwise(v)), steps, F.col("unit"))
    cut = cut.withColumn("unit", F.explode(F.filter(F.array(segment.bind(unit, usable)), lambda u: u.isNotNull())))
    cut = once(cut, ["qid"], "unit", ["rank", "ord"])
    number = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "ord"))
    return cut.withColumn("uid", F.concat(F.lit("u"), number.cast("string"))).drop("text")


def unit_scores(units: DataFrame, questions: DataFrame, idf: DataFrame) -> DataFrame:
    """Offline selector's score: idf of the question's terms that a unit has."""
    asked = questions.select("qid", F.explode(F.array_distinct(X.tokens("question"))).alias("term")).join(idf.select("term", "idf"), "term", "left").select("qid", "term", F.coalesce("idf", F.lit(1.0)).alias("w"))
    has = units.select("qid", "uid", F.explode(F.array_distinct(X.tokens("unit"))).alias("term"))
    got = has.join(asked, ["qid", "term"]).groupBy("qid", "uid").agg(F.sum("w").alias("fit"))
    return units.join(got, ["qid", "uid"], "left").withColumn("fit", F.coalesce("fit", F.lit(0.0)))


def select_units(scored: DataFrame, most: int = 6) -> DataFrame:
    """The best of the house's own first, at most half (rounded up) if there are others; these get what is left."""
    own = F.col("source_type") == INSTITUTIONAL
    any_outside = F.max((~own).cast("int")).over(Window.partitionBy("qid"))
    rows = scored.withColumn("_own", own).withColumn("_limit", F.when(any_outside == 1, (most + 1) // 2).otherwise(most)).where("fit > 0")
    nth = F.row_number().over(Window.partitionBy("qid", "_own").orderBy(F.round("fit", 9).desc(), "rank", "ord"))
    rows = rows.withColumn("_n", nth)
    taken = F.sum((F.col("_own") & (F.col("_n") <= F.col("_limit"))).cast("int")).over(Window.partitionBy("qid"))
    rows = rows.withColumn("_taken", taken)
    return rows.where(F.when(F.col("_own"), F.col("_n") <= F.col("_limit")).otherwise(F.col("_n") <= most - F.col("_taken"))).drop("_own", "_limit", "_n", "_taken")


def chosen_units(units: DataFrame, picks: DataFrame) -> DataFrame:
    """Units of a selector's ids (qid, pos, uid): unknown ids are ignored, repeated ones count once, in order of selection."""
    firsts = picks.groupBy("qid", "uid").agg(F.min("pos").alias("pos"))
    return units.join(firsts, ["qid", "uid"])


def picks(replies: DataFrame) -> DataFrame:
    """(qid, pos, uid) of a selector's replies (qid, reply), as `{"ids": [...]}`; a reply that can't be read picks nothing."""
    return replies.select("qid", F.posexplode(F.from_json("reply", "struct<ids:array<string>>")["ids"]).alias("at", "uid")).where("uid IS NOT NULL").select("qid", (F.col("at") + 1).alias("pos"), "uid")


def translations(replies: DataFrame, units: DataFrame) -> DataFrame:
    """(qid, uid, translation) of a translator's replies (qid, reply), as `{"traducciones": {uid: text}}`.

    Unreadable replies, empty texts and ids that are none of the English units
    are left out, so those units keep their own words; a repeated id before a
    text goes.
    """
    said = replies.select("qid", F.explode(F.from_json("reply", "struct<traducciones:map<string,string>>")["traducciones"]).alias("uid", "translation"))
    said = said.withColumn("translation", F.trim(F.regexp_replace("translation", LEADING_ID, ""))).where("translation <> ''")
    return said.join(units.where(X.is_english("unit")).select("qid", "uid"), ["qid", "uid"], "left_semi")


def batches(units: DataFrame, size: int = 3) -> DataFrame:
    """Number of the translation batch of each English unit."""
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "ord")) - 1
    return units.where(X.is_english("unit")).withColumn("batch", F.floor(nth / size))


def compose(units: DataFrame, translations: DataFrame | None = None, fallback: str = W.REFUSAL_TEXT) -> DataFrame:
    """(qid, answer): bullets with citations, the house's own in document order first; no unit: the fallback.

    A translated unit (qid, uid, translation) is cleaned as units are, and marked.
    """
    rows = units
    if translations is not None:
        rows = rows.join(translations.select("qid", "uid", F.trim(F.regexp_replace("translation", LEADING_ID, "")).alias("_t")), ["qid", "uid"], "left")
        rows = rows.withColumn("unit", F.when(F.coalesce(F.col("_t"), F.lit("")) == "", F.col("unit")).otherwise(F.concat(X.clean_unit("_t"), F.lit(f" {TRANSLATED}"))))
    own = F.col("source_type") == INSTITUTIONAL
    zero = F.lit(0)
    page = F.coalesce(F.col("page"), zero)
    key = F.struct(F.when(own, 0).otherwise(1).alias("a"), F.when(own, F.col("source_file")).otherwise("").alias("b"), F.when(own, page).otherwise(F.col("rank")).alias("c"), F.when(own, F.col("chunk_index")).otherwise(zero).alias("d"), F.col("ord").alias("e"))
    line = F.concat(F.lit("- "), F.col("unit"), F.lit(" "), X.citation(F.col("source_file"), F.col("section"), F.col("page")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("qid").agg(F.when(F.count("*") > 0, joined).otherwise(fallback).alias("answer"))


def extractive_answer(retrieved: DataFrame, questions: DataFrame, idf: DataFrame, most: int = 6, least: float = 0.1, translate: Callable | None = None) -> DataFrame:
    """Gate, merge, units, selection, translation, text; every question gets a row, the fallback if nothing is left."""
    rows = merge_continuations(relevance_gate(retrieved, least))
    units = select_units(unit_scores(build_units(rows), questions, idf), most)
    answers = compose(units, translate(batches(units)) if translate else None)
    return questions.select("qid").join(answers, "qid", "left").withColumn("answer", F.coalesce("answer", F.lit(W.REFUSAL_TEXT)))


def by_source(own: Column, outside: Column) -> Column:
    """Texts of both groups without those that refuse; both refuse: the own one, else the other, else empty."""
    good = lambda c: F.when(~X.is_refusal(c), F.regexp_replace(c, r"\[[0-9, ]+\]", ""))
    both = F.concat_ws("\n\n", good(own), good(outside))
    return F.when(both != "", both).otherwise(F.coalesce(own, outside, F.lit("")))


def context(rows: DataFrame, empty: str = "(no context)") -> DataFrame:
    """(qid, context): numbered blocks in rank order."""
    block = X.context_block(F.col("rank"), X.citation(F.col("source_file"), F.col("section"), F.col("page")), F.col("text"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context")).withColumn("context", F.coalesce(F.nullif("context", F.lit("")), F.lit(empty)))


def selector_prompt(units: DataFrame, questions: DataFrame | None = None, instruction: str | None = None) -> DataFrame:
    """(qid, prompt): units with a source header only where the source changes; with the question before them and the instruction after, if given."""
    w = Window.partitionBy("qid").orderBy("rank", "ord")
    title = F.coalesce("source_title", "source_file") if "source_title" in units.columns else F.col("source_file")
    head = X.source_header(F.col("source_type"), title, F.col("section"), F.col("page"))
    rows = units.withColumn("_c", head).withColumn("_last", F.lag("_c").over(w))
    line = F.concat_ws("\n", F.when(~F.col("_c").eqNullSafe(F.col("_last")), F.col("_c")), F.concat(F.lit("  "), "uid", F.lit(": "), "unit"))
    listed = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))
    if questions is not None:
        asked = F.concat(F.lit("PREGUNTA:\n"), "question", F.lit("\n\nORACIONES:\n"), "prompt")
        listed = listed.join(questions.select("qid", "question"), "qid").select("qid", asked.alias("prompt"))
    return listed.withColumn("prompt", F.concat("prompt", F.lit(f"\n\nINSTRUCCION ADICIONAL:\n{instruction}"))) if instruction else listed


def group_instruction(group: Column, extra: Column, instructions: dict[str, str], shared: str = "") -> Column:
    """what a generator is told of a group of sources: the group's own part, the shared one and the extra one, empty ones left out."""
    own = F.lit(None).cast("string")
    for name, said in instructions.items():
        own = F.when(group == name, F.lit(said)).otherwise(own)
    parts = F.filter(F.array(own, F.lit(shared), extra), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.array_join(parts, "\n")
