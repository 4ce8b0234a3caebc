"""Secret scans in DataFrame functions only (operator 4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import common

#: The base patterns, in listed order. Runs of access and hex
#: characters are maximal, so their least lengths can stand in the pattern;
#: a short assign match still consumes its text, so it is dropped afterwards.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8

#: Candidates of the entropy scan and its window, in characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: The characters of a candidate.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: A candidate is scanned in pieces of at most so many characters, one less than a window of which overlap, so that time is linear in its length.
PIECE = 200
PIECES = rf"(?=(.{{1,{PIECE}}})).{{1,{PIECE - WINDOW + 1}}}"
#: Matches that are summed up together.
GROUP = 256
#: Least bits a character in some window, by character class.
BITS = {"hex": 3.0, "mixed": 3.7}
#: Values that are not secrets as a whole: no digit or no letter, UUIDs, paths of words.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    # possessive: a part is never tried again, so that a path of any length needs no stack
    r"^(?:[A-Za-z]++[0-9]{0,4}+[/_-])*+[A-Za-z]++[0-9]{0,4}+$",
)
#: Placeholder words standing alone: only they are cut out, what is left of and right of one is a value of its own.
PLACEHOLDER = r"(?i)(?<![A-Za-z0-9])(example|sample|dummy|changeme|placeholder|redacted|your(?=[_-])|test(?=[_-]))(?![A-Za-z0-9])"
#: Runs of one character and counting rows: each is broken so that all windows are left that do not hold six of the run or the whole row.
BREAKS = (
    (r"(.)\1{5,}", "$1$1$1$1$1 $1$1$1$1$1"),
    *((f"(?i)({row[0]})({row[1:-1]})({row[-1]})", "$1$2 $2$3") for row in ("0123456", "1234567", "abcdefg", "qwertyu")),
)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, found: Column, pattern: str, kind: int, keep=None) -> Column:
    """Positions (code points) of all matches, from the lengths of the matches and of the text between them.

    Matches are summed up in groups of GROUP, and the groups then: an array that
    grows by one match at a time would be copied once a match.
    """
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("width"), hit.alias("hit")))
    span = "struct<start:int,kind:int,end:int,hit:string>"
    none, no_groups = F.array().cast(f"array<{span}>"), F.array().cast(f"array<array<{span}>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        here = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["width"]).alias("end"), x["hit"].alias("hit"))
        return F.struct((start + x["width"]).alias("at"), F.concat(s["out"], F.array(here)).alias("out"))

    def group(s: Column, g: Column) -> Column:
        inner = F.aggregate(g, F.struct(s["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(s["out"], F.array(i["out"])).alias("out")))

    last = F.floor((F.size(found) - 1) / GROUP).cast("int")
    groups = _let(pairs, lambda p: F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(p, g * GROUP + 1, GROUP)))
    spans = F.flatten(F.aggregate(groups, F.struct(F.lit(0).alias("at"), no_groups.alias("out")), group, lambda s: s["out"]))
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["hit"]))
    return F.when(F.size(found) > 0, spans).otherwise(none)


def _window_weight(value: Column) -> Column:
    """Least sum of c * log2(c) over the character counts c of all windows, times 10^6.

    `counts` holds how often the window has each character. At a step one
    leaves and one enters; the two counts change, and the sum by their terms.
    Entropy is log2(WINDOW) - sum / WINDOW. For values of at most PIECE.
    """
    term = F.array(*(F.lit(0 if c < 2 else round(c * math.log2(c) * 1e6)) for c in range(WINDOW + 1)))
    up = lambda c: F.get(term, c + 1) - F.get(term, c)
    put = lambda counts, at, n: F.concat(F.slice(counts, 1, at), F.array(n), F.slice(counts, at + 2, len(ALPHABET)))
    codes = F.transform(F.split(value, "(?!^)(?!$)", -1), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    moves = _let(codes, lambda c: F.zip_with(c, F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(c, 1, F.greatest(F.size(c) - WINDOW, F.lit(0)))), lambda e, l: F.struct(e.alias("enters"), l.alias("leaves"))))

    def leave(s: Column, code: Column) -> Column:
        less = lambda n: F.struct((s["total"] - up(n)).alias("total"), s["least"].alias("least"), (s["at"] + 1).alias("at"), put(s["counts"], code, n).alias("counts"))
        kept = F.struct(s["total"].alias("total"), s["least"].alias("least"), (s["at"] + 1).alias("at"), s["counts"].alias("counts"))
        return F.when(code >= 0, _let(F.get(s["counts"], code) - 1, less)).otherwise(kept)

    def enter(s: Column, code: Column) -> Column:
        def more(n: Column) -> Column:
            total = s["total"] + up(n)
            least = F.when(s["at"] >= WINDOW, F.least(s["least"], total)).otherwise(s["least"])
            return F.struct(total.alias("total"), least.alias("least"), s["at"].alias("at"), put(s["counts"], code, n + 1).alias("counts"))

        return _let(F.get(s["counts"], code), more)

    start = F.struct(F.lit(0).alias("total"), F.lit(2**31 - 1).alias("least"), F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"))
    return F.aggregate(moves, start, lambda s, m: _let(leave(s, m["leaves"]), lambda t: enter(t, m["enters"])), lambda s: s["least"])


def _is_secret(candidate: Column) -> Column:
    most = lambda bits: round((math.log2(WINDOW) - bits) * WINDOW * 1e6)

    def listed(value: Column) -> Column:
        out = F.lit(False)
        for pattern in ALLOWED:
            out |= value.rlike(pattern)
        return out

    def holds(value: Column) -> Column:
        limit = F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), most(BITS["hex"])).otherwise(most(BITS["mixed"]))
        parts = value
        for pattern, broken in BREAKS:
            parts = F.regexp_replace(parts, pattern, broken)
        scan = lambda piece: F.when(F.length(piece) >= WINDOW, _window_weight(piece) <= limit).otherwise(False)
        found = F.exists(F.split(parts, " ", -1), lambda part: F.when(F.length(part) >= WINDOW, F.exists(F.regexp_extract_all(part, F.lit(PIECES), F.lit(1)), scan)).otherwise(False))
        return F.when((F.length(value) < WINDOW) | listed(value), F.lit(False)).otherwise(found)

    return F.when(listed(candidate), F.lit(False)).otherwise(F.exists(F.split(candidate, PLACEHOLDER, -1), holds))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (text:
    kind:start:end, comma-joined), base and found (arrays of struct<start, kind,
    end, hit>, in that order). `entropy` spans are matches of CANDIDATE that are
    not on the allow list, of which some window beside placeholder words, runs
    and counting rows reaches BITS, and that lie in no base span.

    A null or empty text has no spans. Texts and candidates may be of any
    length; time is linear in them. Equal and null ids stay apart, and repeated
    rows get equal results; other columns are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    rows = rows.select("doc_id", "text", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(patterns)))
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST
    rows = rows.withColumns({f"s{k}": _spans(text, F.col(f"m{k}"), p, k, long_enough if k == 0 else _is_secret if k == 3 else None) for k, p in enumerate(patterns)})
    base = F.array_sort(F.concat("s0", "s1", "s2"))
    added = F.filter("s3", lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    n = lambda k: F.size(F.col(f"s{k}")).cast("long")
    rows = rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), base.alias("base"), "s3")
    rows = rows.withColumn("found", F.array_sort(F.concat("base", added)))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"), "base", "found")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(common.table(spark, sf_dir, "documents")).drop("base", "found")
