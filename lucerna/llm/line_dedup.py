"""Line dedup by an exact set-similarity join, in DataFrame functions only (operator 9).

A line's tokens are its 5-word shingles. Lines with equal words are one class;
a line of one to four words only matches its equals, a longer one each line
whose shingles have a Jaccard similarity of `percent`. Such sets share a token
of their prefixes under any order of all tokens, so the join runs in two steps:

1. An order that needs no counts. Shingles that start with an anchor letter
   come first, by rank and hash, so only those must be made where a line has
   enough of them. Prefixes are long enough to hold SHARED tokens in common, so
   a class whose prefix shares fewer is left alone. Tokens are counted over all
   classes; classes that share a token of few classes are compared at once.
2. Tokens of many classes. Only classes with one in their prefix can match by
   it, and only among themselves: their tokens are counted anew and ordered by
   rarity, which makes the crowded ones the last. Prefix, length and position
   filters follow; a class is compared with the earliest class of each token,
   and only classes without a match with all earlier ones, in a semi-join that
   verifies as it goes and so never writes out the pairs of a group.

Verified matches are removed if they come later. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import common

SHINGLE = 5
PERCENT = 80
#: Classes up to which all pairs of a token of step 1 are compared at once.
FEW = 16
#: Tokens of step 1 that similar sets share at least, where they have as many: prefixes are longer by one less.
SHARED = 3
#: Rows of stored lists (at most 64 bytes each) up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: The same for lists of line numbers, in bytes.
BROADCAST_BYTES = 64 << 20
#: Letters that start an anchored shingle, by rank: some more of the first than a prefix needs. Any choice gives the same result.
ANCHORS = ("a-dh-l", "e-gmn")
_SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["c1", "c2"]


def _normal(line: Column) -> Column:
    """Lower-cased words with single blanks between; only lines with other blanks need a pattern."""
    low = F.lower(line)
    odd = F.startswith(low, F.lit(" ")) | F.endswith(low, F.lit(" "))
    for blank in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd |= F.contains(low, F.lit(blank))
    return F.when(odd, F.btrim(F.regexp_replace(low, _SPACE, " "), F.lit(" "))).otherwise(low)


def _shingles(body: Column, first: str = "[^ ]") -> Column:
    """Distinct hashes of the shingles whose first word starts with a character of the class `first`, ascending."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), body), F.lit(rf" (?=({first}[^ ]*{" [^ ]+" * (SHINGLE - 1)}))"), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s))))


def _shingle_set(words: str) -> Column:
    """Distinct hashes of all shingles of a list of words, word by word; for sets, which only meet sets."""
    last = F.size(words) - SHINGLE
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(last >= 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))


def _least(n: Column, percent: int) -> Column:
    """The overlap that a set of n needs at least; n less it, plus k, is the length of a prefix that holds k shared tokens."""
    return F.ceil(n * F.lit(percent) / F.lit(100)).cast("int")


def _bodies(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, line, body of every line. A text is hashed once, before it is split, and no line carries it."""
    hashed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))


def _lines(rows: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, line, words, c1, c2 (class), prefix (of step 1) of every line; no words, no class' use."""
    out = _bodies(rows).withColumn("body", _normal(F.col("body")))
    body = F.col("body")
    words = F.when(body == "", 0).otherwise(F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit(""))) + 1)
    n = F.col("words") - (SHINGLE - 1)
    out = out.withColumn("words", words).withColumn("take", F.when(n > 0, n - _least(n, percent) + SHARED).otherwise(0))
    none = F.array().cast("array<bigint>")
    out = out.withColumn("anchored", F.when(F.col("take") > 0, _shingles(body, f"[{ANCHORS[0]}]")).otherwise(none))
    # those of a later rank follow, and are made only where the earlier ones are too few
    for first in (f"[{ANCHORS[1]}]", f"[^ {''.join(ANCHORS)}]"):
        more = F.concat("anchored", _shingles(body, first))
        out = out.withColumn("anchored", F.when(F.size("anchored") >= F.col("take"), F.col("anchored")).otherwise(more))
    prefix = F.slice("anchored", 1, F.col("take"))
    return out.select("doc_id", "text_hash", "line", "words", F.xxhash64("body").alias("c1"), F.xxhash64(F.lit(1), "body").alias("c2"), prefix.alias("prefix"))


def _overlaps(mine: str, theirs: str, percent: int) -> Column:
    shared = F.size(F.array_intersect(mine, theirs))
    return F.lit(100 + percent) * shared >= F.lit(percent) * (F.size(mine) + F.size(theirs))


def _lengths(a: str, b: str, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _places(percent: int) -> Column:
    """Position filter: what is left after a shared token, at `place` and `other_place`, can still reach the overlap."""
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place")) - 1
    return left * (100 + percent) >= F.lit(percent) * (F.col("n") + F.col("other_n"))


def _sets(classes: DataFrame, alive: DataFrame, rows: DataFrame) -> DataFrame:
    """c1, c2, first, need, most, n, tokens of the classes `alive`, from the text of their first line."""
    wanted = common.stored(classes.drop("prefix").join(common.small(alive, BROADCAST_ROWS), _KEY).select(*_KEY, "first", "need", "most", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), F.col("first.line").alias("line")), "wanted")
    source = _bodies(rows).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("line").alias("_line"), "body")
    held = source.join(common.small(wanted, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")) & (F.col("_line") == F.col("line")))
    held = held.select(*_KEY, "first", "need", "most", F.split(_normal(F.col("body")), " ", -1).alias("words")).select(*_KEY, "first", "need", "most", _shingle_set("words").alias("tokens"))
    out = common.stored(held.select(*_KEY, "first", "need", "most", F.size("tokens").alias("n"), "tokens"), "sets", repeats=False)
    common.dropped(wanted)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later class (c1, c2) of each pair (c1, c2, d1, d2) whose sets reach the similarity."""
    used = common.stored(pairs.select(*_KEY).union(pairs.select("d1", "d2")).distinct(), "used")
    own = sets.join(common.small(used, BROADCAST_ROWS), _KEY, "left_semi")
    both = pairs.join(own.select(*_KEY, "first", F.col("tokens").alias("mine")), _KEY).join(own.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("first").alias("other"), F.col("tokens").alias("theirs")), ["d1", "d2"])
    later = F.when(F.col("first") > F.col("other"), F.struct("c1", "c2")).otherwise(F.struct(F.col("d1").alias("c1"), F.col("d2").alias("c2")))
    out = common.stored(both.where(_overlaps("mine", "theirs", percent)).select(later.alias("k")).select("k.*").distinct(), "verified")
    common.dropped(used)
    return out


def _thin_matches(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Later classes of the pairs that share a token of step 1 with at most FEW classes.

    Where a class has only such tokens, a pair with it must share as many of them as both need.
    """
    thin = members.where(F.col("size") <= FEW).select("token", *_KEY)
    thin = thin.join(common.small(sets.select(*_KEY, "n", "need", (F.col("most") <= FEW).alias("whole")), BROADCAST_ROWS), _KEY)
    other = thin.select("token", F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("n").alias("other_n"), F.col("need").alias("other_need"), F.col("whole").alias("other_whole"))
    apart = (F.col("c1") < F.col("d1")) | ((F.col("c1") == F.col("d1")) & (F.col("c2") < F.col("d2")))
    pairs = thin.join(other, "token").where(apart & _lengths("n", "other_n", percent)).groupBy(*_KEY, "d1", "d2")
    pairs = pairs.agg(F.count("*").alias("shared"), F.max(F.when(F.col("whole") | F.col("other_whole"), F.greatest("need", "other_need")).otherwise(1)).alias("need"))
    pairs = common.stored(pairs.where("shared >= need").select(*_KEY, "d1", "d2"), "pairs")
    out = _verified(pairs, sets, percent)
    common.dropped(pairs)
    return out


def _crowded_matches(sets: DataFrame, percent: int) -> DataFrame:
    """Classes of `sets` that an earlier one of them matches: a self-join with tokens ordered by their count among them."""
    each = sets.select(*_KEY, "first", "n", F.explode("tokens").alias("token"))
    counts = common.stored(each.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"), "token-counts")
    ranked = each.join(common.small(counts, BROADCAST_ROWS), "token").groupBy(*_KEY, "first", "n").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    take = F.col("n") - _least(F.col("n"), percent) + 1 - alone
    members = ranked.where(take > 0).select(*_KEY, "first", "n", alone.alias("alone"), F.posexplode(F.slice("shared", 1, take)).alias("at", "x"))
    members = common.stored(members.select(*_KEY, "first", "n", (F.col("alone") + F.col("at")).alias("place"), F.col("x.token").alias("token")), "crowded")

    fits = _lengths("n", "other_n", percent) & _places(percent)
    heads = members.groupBy("token").agg(F.min(F.struct("first", *_KEY, "n", "place")).alias("head"), F.count("*").alias("size")).where("size > 1")
    heads = common.stored(heads.select("token", F.col("head.c1").alias("d1"), F.col("head.c2").alias("d2"), F.col("head.n").alias("other_n"), F.col("head.place").alias("other_place"), "size"), "heads")
    to_head = members.join(common.small(heads, BROADCAST_ROWS), "token").where(((F.col("c1") != F.col("d1")) | (F.col("c2") != F.col("d2"))) & fits)
    pairs = common.stored(to_head.select(*_KEY, "d1", "d2").distinct(), "pairs")
    found = _verified(pairs, sets, percent)

    # the rest of each group, without classes that have their match: every earlier member counts
    groups = members.join(common.small(heads.where("size > 2").select("token"), BROADCAST_ROWS), "token", "left_semi")
    left = common.stored(groups.join(common.small(found, BROADCAST_ROWS), _KEY, "left_anti"), "left")
    open_ = groups.join(common.small(left.select("token").distinct(), BROADCAST_ROWS), "token", "left_semi")
    mine = left.join(sets.select(*_KEY, "tokens"), _KEY)
    theirs = open_.join(sets.select(*_KEY, "tokens"), _KEY).select("token", F.col("first").alias("other_first"), F.col("n").alias("other_n"), F.col("place").alias("other_place"), F.col("tokens").alias("theirs"))
    on = (mine["token"] == theirs["token"]) & (F.col("other_first") < F.col("first")) & fits & _overlaps("tokens", "theirs", percent)
    rest = common.stored(mine.join(theirs, on, "left_semi").select(*_KEY).distinct(), "rest")
    out = common.stored(found.union(rest), "found")
    common.dropped(counts, members, heads, pairs, found, left, rest)
    return out


def _kept_lines(rows: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, copies (rows equal in both), n_lines, worded, kept (line numbers) of every document."""
    lines = common.stored(_lines(rows, percent), "lines", repeats=False)
    # a class keeps the prefix of its first line: each of its tokens is counted and dealt out once, however many lines it has
    first = F.min(F.struct("doc_id", "text_hash", "line", "prefix")).alias("first")
    classes = lines.where("words > 0").groupBy(*_KEY).agg(first)
    classes = common.stored(classes.select(*_KEY, F.struct("first.doc_id", "first.text_hash", "first.line").alias("first"), "first.prefix"), "classes", repeats=False)
    documents = lines.groupBy("doc_id", "text_hash").agg(F.count_if(F.col("line") == 0).alias("copies"), (F.max("line") + 1).alias("n_lines"), F.collect_set(F.when(F.col("words") > 0, F.col("line"))).alias("worded"))
    documents = common.stored(documents, "line-documents")
    common.dropped(lines)

    # a similar set holds `need` tokens of this prefix in its own: at least SHARED, or the overlap of a smaller set
    need = F.least(F.lit(SHARED), _least(F.size("prefix"), percent)).alias("need")
    each = classes.select(*_KEY, need, F.explode("prefix").alias("token"))
    sizes = common.stored(each.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "sizes", repeats=False)
    members = common.stored(each.join(common.small(sizes, 4 * BROADCAST_ROWS), "token"), "members")
    alive = members.groupBy(*_KEY).agg(F.max("need").alias("need"), F.max("size").alias("most"), F.count("*").alias("held"))
    alive = common.stored(alive.where("held >= need").drop("held"), "alive")
    sets = _sets(classes, alive, rows)
    thin = _thin_matches(members, sets, percent)
    common.dropped(members, sizes)
    many = common.stored(sets.where(F.col("most") > FEW).drop("need", "most"), "crowded-sets", repeats=False)
    common.dropped(sets, alive)
    matched = common.stored(thin.union(_crowded_matches(many, percent)).distinct(), "matched")
    common.dropped(many, thin)

    first = classes.join(common.small(matched, BROADCAST_ROWS), _KEY, "left_anti").select("first.*")
    kept = first.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("kept"))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept")
    out = documents.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    out = common.stored(out.select("doc_id", "text_hash", "copies", "n_lines", "worded", F.coalesce("kept", F.array().cast("array<int>")).alias("kept")), "kept-lines")
    common.dropped(documents, classes, matched)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, ascending) of every row.

    A line (text between line breaks) is removed if an earlier line, by
    doc_id, then text hash, then place, in any document, has an equal or
    similar set of shingles. Words are lower-cased runs without ASCII white
    space; a line of one to four words goes if it repeats an earlier one; blank
    lines stay. A null text is one empty line. Null ids come first in order. Of
    rows equal in id and text, one counts as the first; all worded lines of the
    others are removed. A text may be of any length. Extra columns are ignored;
    an empty table gives an empty result.
    """
    out = _kept_lines(_rows(docs, id_col, text_col), percent)
    out = out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "worded", "kept", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    gone = F.sort_array(F.when(F.col("copy") == 1, F.array_except("worded", "kept")).otherwise(F.col("worded")))
    return out.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))


def drop_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents without the lines that `removed_lines` names.

    All columns stay; `length_col`, if there is one, is counted anew for
    changed texts. A document none of whose worded lines are left goes; one
    without any stays. Of rows equal in id and text that have a worded line,
    one stays. Columns may have any names. An empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col)
    held = _kept_lines(rows, percent)
    changed = held.where((F.size("worded") > F.size("kept")) | ((F.col("copies") > 1) & (F.size("worded") > 0)))
    marks = common.stored(changed.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.sort_array(F.array_except("worded", "kept")).alias("gone"), (F.size("kept") > 0).alias("stays"), "copies"), "gone")
    common.dropped(held)
    size = marks.agg(F.sum(F.lit(64) + 4 * F.size("gone"))).first()[0] or 0
    text = F.col(f"`{text_col}`")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("own_hash"))
    whole = whole.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left")
    whole = whole.where(F.coalesce("stays", F.lit(True)))
    if not marks.where("copies > 1 AND stays").isEmpty():
        again = F.coalesce(F.col("copies") > 1, F.lit(False))
        whole = whole.where(~again).union(whole.where(again).dropDuplicates(["own_id", "own_hash"]))
    own = F.col("row")[text_col]
    kept = F.array_join(F.filter(F.split(own.cast("string"), "\n", -1), lambda body, i: ~F.array_contains(F.col("gone"), i)), "\n")
    cut = F.size("gone") > 0
    out = []
    for name, kind in docs.dtypes:
        column = F.col("row")[name]
        if name == text_col:
            column = F.when(cut, kept).otherwise(column)
        elif name == length_col:
            column = F.when(cut, F.length(kept).cast(kind)).otherwise(column)
        out.append(column.alias(name))
    return whole.select(*out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(common.table(spark, sf_dir, "documents"))
