"""Text functions as Column expressions (ids F1 to F39 of the blueprint).

A null text counts as empty unless stated otherwise.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.functions import words as W


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@functools.cache
def _decompositions() -> tuple[str, str, str, str]:
    """What folding makes of each code point, by the rule itself (compatibility decomposition of the lower case, without marks).

    Characters that become one character and the ones they become, then those
    that vanish, as `translate` takes them; characters that become several, and
    what they become, joined by \x01. Hangul syllables, which follow from their
    numbers, are left out.
    """
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xAC00 + 11_172:
            continue
        char = chr(point)
        folded = "".join(x for x in unicodedata.normalize("NFKD", char.lower()) if not unicodedata.combining(x))
        if folded != char:
            (several if len(folded) > 1 else one)[char] = folded
    changed = [c for c in one if one[c]]
    return "".join(changed) + "".join(c for c in one if not one[c]), "".join(one[c] for c in changed), "".join(several), "\x01".join(several.values())


#: The parts of which the standard composes Hangul syllables, by first code point and number.
_HANGUL = ((0x1100, 19), (0x1161, 21), (0x11A8, 27))


def _expanded(x: Column) -> Column:
    """A text with the characters that fold to several replaced, one by one."""
    _, _, keys, values = _decompositions()
    heads, middles, tails = ("".join(map(chr, range(first, first + n))) for first, n in _HANGUL)

    def one(c: Column) -> Column:
        number = F.ascii(c) - 0xAC00
        part = lambda chars, k: F.substring(F.lit(chars), k + 1, 1)
        head = part(heads, F.floor(number / (21 * 28)).cast("int"))
        middle = part(middles, F.floor(number % (21 * 28) / 28).cast("int"))
        tail = F.when(number % 28 > 0, part(tails, (number % 28 - 1).cast("int"))).otherwise("")
        found = lambda k: F.when(k > 0, F.split_part(F.lit(values), F.lit("\x01"), k)).otherwise(c)
        return F.when((number >= 0) & (number < 11_172), F.concat(head, middle, tail)).otherwise(bind(F.instr(F.lit(keys), c), found))

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), one), "")


def fold(c: Column | str) -> Column:
    """lower case, compatibility decomposition, no combining marks.

    ASCII stays as it is; one table maps most other characters, and only texts
    with one that becomes several (ligatures, fractions, Hangul) are taken apart.
    """
    changed, to, several, _ = _decompositions()

    def mapped(x: Column) -> Column:
        rare = x.rlike(r"[^\x00-\x7F]") & ((F.length(F.translate(x, several, "")) < F.length(x)) | x.rlike("[\uac00-\ud7a3]"))
        return F.when(rare, _expanded(x)).otherwise(x)

    return bind(F.lower(text(c)), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), bind(F.translate(x, changed, to), mapped)).otherwise(x))


def _prefix_tree(words) -> str:
    """A pattern of the words that shares their beginnings, so that a word is tested in as many steps as it has letters."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    parts = [re.escape(h) + (_prefix_tree(rest) if rest != [""] else "") for h, rest in heads.items() if h]
    return "(?:" + "|".join(parts) + ")" + ("?" if ends else "") if parts else ""


def tokens(c: Column | str, stop=W.STOPWORDS) -> Column:
    """folded runs of letters and digits that are not stop words; negations stay. One pattern finds them, without a test by row and word."""
    skipped = f"(?!{_prefix_tree(stop)}(?![a-z0-9]))" if stop else ""
    return F.regexp_extract_all(fold(c), F.lit(f"(?<![a-z0-9]){skipped}[a-z0-9]++"), F.lit(0))


def query_tokens(c: Column | str, meta=W.META) -> Column:
    """tokens that do not speak of the collection; all of them if none is left."""
    held, all_ = _strings(meta), tokens(c)
    rest = F.filter(all_, lambda t: ~F.array_contains(held, t))
    return F.when(F.size(rest) == 0, all_).otherwise(rest)


def retrieval_query(c: Column | str, meta=W.META, generic=W.GENERIC) -> Column:
    """the sub-questions (split after `?`) that have a word of substance, or the whole if there is one part or none has."""
    whole = text(c)
    parts = F.filter(F.transform(F.split(whole, r"(?<=\?)"), lambda s: F.trim(s)), lambda p: p != "")
    dull = _strings([*meta, *generic])
    kept = lambda each: F.filter(each, lambda p: F.exists(tokens(p), lambda t: ~F.array_contains(dull, t)))
    joined = lambda good: F.when(F.size(good) == 0, whole).otherwise(F.array_join(good, " "))
    return bind(parts, lambda each: F.when(F.size(each) < 2, whole).otherwise(bind(kept(each), joined)))


def content_words(c: Column | str, generic=W.GENERIC, endings=W.VERB_ENDINGS, verbs=W.VERB_WORDS) -> Column:
    """query tokens of four letters or more that are no numbers, general words or verbs."""
    dull = _strings([*generic, *verbs])
    like_verb = "(" + "|".join(endings) + ")$"
    return F.filter(query_tokens(retrieval_query(c)), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$") & ~F.array_contains(dull, t) & ~t.rlike(like_verb))


def word_list(c: Column | str) -> Column:
    """Words between white space (Unicode)."""
    return F.filter(F.split(text(c), r"(?U)\s+"), lambda w: w != "")


def n_words(c: Column | str) -> Column:
    return F.size(word_list(c))


def approx_tokens(c: Column | str) -> Column:
    """words / 0.75, cut to an integer, at least 1."""
    return F.greatest(F.lit(1), (n_words(c) / F.lit(0.75)).cast("int"))


def strip_emphasis(c: Column | str) -> Column:
    """F7."""
    return F.trim(F.regexp_replace(text(c), r"[*_]+", ""))


def clean_title(c: Column | str) -> Column:
    """F8: no emphasis, no blank, colon or dot at the end."""
    return F.rtrim(strip_emphasis(c), F.lit(" :."))


def _unescaped(c: Column) -> Column:
    """`#Uxxxx` as the character it stands for."""

    def one(p: Column, i: Column) -> Column:
        char = F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE")
        return F.when(i == 0, p).when(p.rlike("^[0-9a-fA-F]{4}"), F.concat(char, F.substring(p, 5, 1 << 20))).otherwise(F.concat(F.lit("#U"), p))

    return F.when(F.contains(c, F.lit("#U")), F.array_join(F.transform(F.split(c, "#U", -1), one), "")).otherwise(c)


def file_key(c: Column | str) -> Column:
    """escapes `#Uxxxx` decoded, folded, letters and digits only."""
    return F.regexp_replace(fold(_unescaped(text(c))), "[^a-z0-9]", "")


def line_key(c: Column | str) -> Column:
    """what a running line has in common on all pages: no marks, single blanks, lower case, digit runs as #."""
    x = F.regexp_replace(text(c), r"<[^>]*>", " ")
    x = F.regexp_replace(x, r"^\s*#+\s*", "")
    x = F.regexp_replace(x, r"[*_]+", "")
    x = F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.regexp_replace(x, r"[0-9]+", "#")


# What an extractor leaves in a page: text of pictures and their captions, inline tags, lines without words.
PICTURE_TEXT = r"(?s)<!--\s*Start of picture text\s*-->.*?<!--\s*End of picture text\s*-->"
PICTURE_CAPTION = r"(?imu)^\*\*(gr[aá]fico|figura)\s*[0-9]+\.?\*\*.*$"
INLINE_TAG = r"(?i)</?(mark|u|sup|sub|span|br)\b[^>]*>"
BARE_MARKS = r"(?U)^[\s*_-]*$"
LINE_END = "\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"


def clean_page(c: Column | str, stamps: str = W.STAMP_LINE, boilerplate=W.BOILERPLATE) -> Column:
    """no text or captions of pictures, inline tags, lines with a stamp or contact, or boilerplate; lines of marks alone are blank; at most one blank line.

    Order: pictures, captions, tags, stamps, boilerplate. An address of a page
    alone does not make a line a stamp.
    """
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), PICTURE_TEXT, ""), PICTURE_CAPTION, ""), INLINE_TAG, "")
    x = F.array_join(F.filter(F.split(x, LINE_END, -1), lambda s: ~s.rlike(stamps)), "\n")
    for pattern in boilerplate:
        x = F.regexp_replace(x, pattern, "")
    lines = F.transform(F.split(x, "\n", -1), lambda s: F.when(s.rlike(BARE_MARKS), F.lit("")).otherwise(F.regexp_replace(s, r"(?U)\s+$", "")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def strip_tables(c: Column | str) -> Column:
    """lines whose first and last non-blank characters are pipes go."""
    return F.array_join(F.filter(F.split(text(c), "\n"), lambda s: ~s.rlike(r"^\s*\|.*\|\s*$")), "\n")


def is_reference_line(c: Column | str) -> Column:
    """F13."""
    return text(c).rlike(W.REFERENCE_LINE)


def is_bibliography_title(c: Column | str) -> Column:
    """F13."""
    return fold(strip_emphasis(c)).rlike(W.BIBLIOGRAPHY_TITLE)


def is_bibliography(c: Column | str) -> Column:
    """All lines that are not blank look like references, or at least four and half of them."""
    lines = F.filter(F.split(text(c), "\n"), lambda s: F.trim(s) != "")
    hits = F.size(F.filter(lines, lambda s: s.rlike(W.REFERENCE_LINE)))
    n = F.size(lines)
    return (n > 0) & ((hits == n) | ((hits >= 4) & (2 * hits >= n)))


def is_upper_title(c: Column | str) -> Column:
    """F14."""
    x = text(c)
    return (x == F.upper(x)) & x.rlike(r"\p{L}")


def short_title(c: Column | str, limit: int = 120) -> Column:
    """cut at a word with an ellipsis."""
    x = text(c)
    cut = F.rtrim(F.regexp_replace(F.substring(x, 1, limit), r"(?U)\s+\S*$", ""))
    return F.when(F.length(x) > limit, F.concat(cut, F.lit("…"))).otherwise(x)


def is_numbered_question(c: Column | str) -> Column:
    """F16: a number, and an opening question mark anywhere or a closing one at the end."""
    x = strip_emphasis(c)
    return x.rlike(r"(?U)^[0-9]{1,3}\.\s") & x.rlike(r"(?U)¿|\?\s*$")


def with_header(title: Column, body: Column, default: str = W.DEFAULT_SECTION) -> Column:
    """the title above the text, unless it is empty, the default, or there already."""
    t = strip_emphasis(title)
    skip = (t == "") | (t == default) | F.startswith(strip_emphasis(body), t)
    return F.when(skip, body).otherwise(F.concat(t, F.lit("\n\n"), body))


# What cleaning takes away, and what makes an outside unit unusable.
QUIZ = r"(?iU),?\s*(so|therefore|thus)?\s*the (correct )?answer is \(?[a-e]\)?\.?|\bpor lo que la respuesta es \(?[a-e]\)?\.?"
MARKDOWN = r"(?mU)(\*\*|__|(?<!\w)[*_](?!\s)|(?<!\s)[*_](?!\w)|^#+\s*)"
CALL_OUT = r"(?U)\s*\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]"
INLINE_BULLET = r"(?U)\s*[•➢▪◦]\s*"
TRAILING_CALLS = r"(?U)(?<=[a-z)])(?:\s[0-9]{1,3}){2,4}(?=\s*(?:[;.]|$))"
DOT_CALLS = r"(?U)(?<=[A-Za-z)])\.([0-9]{1,3}(?:[,–-][0-9]{1,3})*)(?=\s|$)"
UNDERSCORE_CALLS = r"(?U)_\s?[0-9]{1,3}(?:[,–-][0-9]{1,3})*\b"
FOOTNOTE_MARKS = r"[†‡§¶]"
CITED = r"(?iU)\bet al\b|doi\.org|\bdoi\s*:|https?://|\bpmid\b|essential reading"
REFERENCE_START = r"(?U)(?:^|(?<=[.;:]\s))[A-Z][\w'-]+ [A-Z]{1,3}(?:,| et al)"
STUDY_SUMMARY = r"(?U)\b(?:[Ee]l|[Uu]n|[Ll]os|[Ee]ste|[Dd]icho)\s+(?:estudio|an[aá]lisis|ensayo|metan[aá]lisis)s?\s+de\s+[A-Z]|\by colaboradores\b"
ABBREVIATION = r"(?U)\b(?!(?:OR|HR|RR)\b)[A-Z][A-Za-z0-9]{1,8}\s?=\s?[A-Za-z]"
LEADING_ABBREVIATION = r"(?U)^[A-Z][\w ]{0,15}?\s?=\s?\S"
ATTRIBUTION = r"(?iU)^(advice|adapted|reproduced|modified|data|source|tomad[oa]|adaptad[oa])\b.{0,40}\b(from|de)\b"
FINITE_VERB = r"(?iU)\b(is|are|was|were|has|have|had|should|can|may|must|recommends?|suggests?|es|son|fue|tiene|tienen|debe|deben|puede|pueden|recomienda|recomendamos|sugerimos)\b"
SENTENCE_END = r"[.!?](?=\s+[A-ZÁÉÍÓÚÑ¿¡])"
TERMINAL = r"[.!?:;)\"»]$"
DANGLING = "the a an of to in for with and or but than that which who we be by from at as plus less more greater el la los las un una de del al en con por para y o que se su sus menor mayor".split()
SHORT_UNIT, SHORT_VERB_UNIT, REFERENCE_HEAD = 15, 8, 4


def clean_unit(c: Column | str) -> Column:
    """quiz answers, marks, numeric call-outs, inline bullets and doubled dots go; single blanks."""
    x = F.regexp_replace(text(c), QUIZ, ".")
    x = F.regexp_replace(x, r"(?U)\.\s*\.", ".")
    x = F.regexp_replace(F.regexp_replace(x, MARKDOWN, ""), CALL_OUT, "")
    x = F.regexp_replace(x, INLINE_BULLET, " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tidy_external(c: Column | str) -> Column:
    """reference calls of other publications: 2 to 4 trailing numbers, numbers after a dot or an underscore, foot-note marks; underscores and blanks before punctuation."""
    x = F.regexp_replace(text(c), TRAILING_CALLS, "")
    x = F.regexp_replace(F.regexp_replace(x, DOT_CALLS, "."), FOOTNOTE_MARKS, "")
    x = F.replace(F.regexp_replace(x, UNDERSCORE_CALLS, ""), F.lit("_"), F.lit(""))
    return F.trim(F.regexp_replace(x, r"(?U)\s+([.,;:])", "$1"))


def strip_references(c: Column | str) -> Column:
    """of a text that cites, what stands before the first surname with initials, if it has four words and does not end in a colon; else nothing."""
    x = text(c)
    at = F.regexp_instr(x, F.lit(REFERENCE_START))
    head = F.trim(F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(""))
    good = (n_words(head) >= REFERENCE_HEAD) & ~F.endswith(head, F.lit(":"))
    return F.when(~x.rlike(CITED), x).when(good, head).otherwise("")


def _dangles(c: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(c), r"(?U)\s+"), -1)).isin(*DANGLING)


def trim_tail(c: Column | str) -> Column:
    """an unfinished last sentence goes if it dangles or is short, and a finished one stands before it."""
    x = text(c)
    body = F.rtrim(x, F.lit(" |"))
    head = F.regexp_extract(body, rf"(?sU)^(.*{SENTENCE_END})", 1)
    tail = F.trim(F.substring(body, F.length(head) + 1, F.length(body)))
    unfinished = ~body.rlike(TERMINAL) & (head != "") & (tail != "") & (_dangles(tail) | (n_words(tail) < SHORT_UNIT))
    return F.when(unfinished, F.trim(head)).otherwise(x)


def is_study_summary(c: Column | str) -> Column:
    """the summary of a study rather than advice."""
    return text(c).rlike(STUDY_SUMMARY)


def unusable_external(c: Column | str) -> Column:
    """abbreviation lists, attributions, leading definitions; short fragments that start in lower case, dangle, or are a clause without its end."""
    x = text(c)
    bare = F.rtrim(x, F.lit(" |"))
    ending = F.regexp_extract(bare, r"([0-9,.\s]+)$", 1)
    body = F.concat(F.regexp_replace(bare, r"[0-9,.\s]+$", ""), F.when(F.contains(ending, F.lit(".")), ".").otherwise(""))
    n, low = n_words(body), x.rlike(r"^\p{Ll}")
    cut = (n < SHORT_UNIT) & ~body.rlike(TERMINAL) & (low | _dangles(body) | ((n < SHORT_VERB_UNIT) & body.rlike(FINITE_VERB)))
    return (F.regexp_count(x, F.lit(ABBREVIATION)) >= 3) | x.rlike(ATTRIBUTION) | x.rlike(LEADING_ABBREVIATION) | (low & (n < SHORT_UNIT)) | cut


def is_refusal(c: Column | str, markers=W.REFUSAL_MARKERS, limit: int = W.REFUSAL_WORDS) -> Column:
    """at most `limit` words and a marker."""
    low = F.lower(text(c))
    return (n_words(c) <= limit) & F.exists(_strings(markers), lambda m: F.contains(low, m))


def abstains(c: Column | str, phrases=W.ABSTENTION) -> Column:
    """E5: a phrase of abstention in a text of any length."""
    return bind(fold(c), lambda x: F.exists(_strings(phrases), lambda p: F.contains(x, p)))


def citations(c: Column | str) -> Column:
    """names cited as `[Guia: name, ...]`."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(W.CITATION), F.lit(1)), lambda s: F.trim(s))


def plain_key(c: Column | str) -> Column:
    """F9 as the key of joins."""
    return file_key(c)


def cites(citation: Column, file: Column) -> Column:
    """equal to the file or its stem, or the start of it."""
    a, whole = plain_key(citation), plain_key(file)
    stem = plain_key(F.regexp_replace(file, r"\.[A-Za-z0-9]{1,5}$", ""))
    return (a != "") & ((a == whole) | (a == stem) | F.startswith(whole, a) | F.startswith(stem, a))


def inference_markers(c: Column | str, phrases=W.INFERENCE) -> Column:
    """the phrases that occur, distinct and sorted."""
    x = fold(c)
    return F.array_sort(F.filter(_strings(phrases), lambda p: F.contains(x, p)))


def mentions_others(c: Column | str, n_documents: Column, phrases: str = W.OTHER_SOURCES, together: str = W.SOURCES_TOGETHER, negation: str = W.NEGATION, reach: int = W.NEGATION_REACH) -> Column:
    """at most one document is the source, and the text speaks of others or of several.

    A phrase for others does not count if the `reach` characters before it end in
    a negation and at most two words; one for several always counts.
    """
    x = fold(c)

    def plain(x: Column) -> Column:
        pieces = F.split(x, phrases, -1)
        found = F.regexp_extract_all(x, F.lit(phrases), F.lit(0))
        # what stands before the k-th phrase: all pieces and phrases up to it
        before = F.transform(F.slice(pieces, 1, F.size(found)), lambda p, k: F.concat(F.when(k > 0, F.get(found, k - 1)).otherwise(""), p))
        held = F.transform(before, lambda p, k: F.array_join(F.slice(before, 1, k + 1), ""))
        return x.rlike(together) | F.exists(held, lambda s: ~F.right(s, F.lit(reach)).rlike(negation))

    return (n_documents <= 1) & bind(x, plain)


def document_key(c: Column | str) -> Column:
    """the protocol code in upper case, else the trimmed lower-case name."""
    code = F.regexp_extract(F.upper(text(c)), W.CODE, 1)
    return F.when(code != "", code).otherwise(F.lower(F.trim(text(c))))


def headline(c: Column | str) -> Column:
    """the lines before the first bullet, joined; all if it starts with one."""
    x = text(c)
    head = F.array_join(F.split(F.regexp_replace(x, r"(?s)(^|\n)•.*$", ""), "\n"), " ")
    return F.when(head == "", x).otherwise(head)


UNKNOWN = "UNKNOWN"
# Words for yes and no, and the beginnings of not knowing.
YES = ("si", "s", "yes", "y", "afirmativo", "positivo", "verdadero", "cumple")
NO = ("no", "n", "negativo", "falso")
NOT_KNOWN = re.compile(r"^(?!no se ha)(no se|nose|no lo se|no sabe|ns|desconoc\w*|sin dato\w*)\b")


def _plain(s: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", (s or "").lower()) if not unicodedata.combining(c)).strip()


def choose(raw: str | None, options: list[str]) -> str | None:
    """an answer in free words as one of the options, UNKNOWN, or nothing.

    Rules in this order, the first that says anything decides: a phrase for not
    knowing; the option's number; the option itself; a word for yes or no,
    where just one option is not, or is, a no; the only option all of whose
    words are in the answer.
    """
    said = _plain(raw).strip(" .,;:!¡?¿")
    plain = [_plain(o) for o in options]
    words = lambda s: set(re.findall("[a-z0-9]+", s))
    nos = [k for k, p in enumerate(plain) if p.startswith("no")]
    texts_of_no = {options[k] for k in nos}
    yeses = [k for k, o in enumerate(options) if o not in texts_of_no]
    if not said:
        return None
    if NOT_KNOWN.match(said):
        return UNKNOWN
    rules = (
        [int(said) - 1] if said.isdigit() and 1 <= int(said) <= len(options) else [],
        [k for k, p in enumerate(plain) if p == said][:1],
        yeses if said in YES and len(yeses) == 1 else [],
        nos if said in NO and len(nos) == 1 else [],
        [k for k, p in enumerate(plain) if words(p) <= words(said)],
    )
    hit = next((r for r in rules if r), [])
    return options[hit[0]] if len(hit) == 1 else None


@F.pandas_udf(T.StringType())
def parse_choice(raw: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([choose(r, list(o) if o is not None else []) for r, o in zip(raw, options)], dtype=object)


def version_label(c: Column | str) -> Column:
    """v and the digits, two at least."""
    return F.format_string("v%02d", F.regexp_extract(text(c), "([0-9]+)", 1).cast("int"))


def qualifier(c: Column | str) -> Column:
    """F32: what follows the first plus sign of a label."""
    return F.trim(F.coalesce(F.get(F.split(text(c), r"\+", 2), 1), F.lit("")))


def html_escape(c: Column | str) -> Column:
    """F33."""
    return F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


SOURCE_LABELS = {"institucional": "Protocolo institucional", "guia": "Guia clinica", "revision": "Revision"}
"""Display text by source type (the keys are fixed values)."""


def source_label(c: Column | str) -> Column:
    """display text of a source type; others as they are."""
    x = F.col(c) if isinstance(c, str) else c
    out = x
    for key, label in SOURCE_LABELS.items():
        out = F.when(x == key, label).otherwise(out)
    return out


def citation(file: Column, section: Column, page: Column) -> Column:
    """[Guia: file, Seccion: section, Pagina: page]; without a page if there is none."""
    return F.concat(F.lit("[Guia: "), file, F.lit(", Seccion: "), section, F.coalesce(F.concat(F.lit(", Pagina: "), page.cast("string")), F.lit("")), F.lit("]"))


def source_header(kind: Column, title: Column, section: Column, page: Column) -> Column:
    """[kind | title | section | p. page], as a selector sees a source."""
    return F.concat(F.lit("["), F.concat_ws(" | ", source_label(kind), title, section, F.concat(F.lit("p. "), F.coalesce(page.cast("string"), F.lit("-")))), F.lit("]"))


def context_block(number: Column, cite: Column, body: Column) -> Column:
    """a numbered block of a prompt."""
    return F.concat(F.lit("("), number.cast("string"), F.lit(") "), cite, F.lit("\n"), body)


def node_tokens(c: Column | str, synonyms: dict[str, str] = W.NODE_SYNONYMS, stop=W.NODE_STOP) -> Column:
    """tokens over two letters that are none of the node's own stop words, synonyms mapped to one word."""
    found = F.filter(tokens(c, stop), lambda t: F.length(t) > 2)
    if not synonyms:
        return found
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.transform(found, lambda t: F.coalesce(F.element_at(table, t), t))


def indent(c: Column | str, by: str = "  ") -> Column:
    """continuation lines set in."""
    return F.regexp_replace(text(c), "\n", "\n" + by)


def drop_blank_lines(c: Column | str) -> Column:
    """F37."""
    return F.array_join(F.filter(F.split(text(c), "\n"), lambda s: F.trim(s) != ""), "\n")


def is_english(c: Column | str) -> Column:
    """More English than Spanish function words."""
    found = F.regexp_extract_all(fold(c), F.lit("[a-z]+"), F.lit(0))
    votes = lambda held: F.size(F.filter(found, lambda w: F.array_contains(_strings(held), w)))
    return votes(W.ENGLISH_VOTE) > votes(W.SPANISH_VOTE)


def is_key_value_block(c: Column | str) -> Column:
    """Three lines `key: value` and half of all."""
    lines = F.filter(F.split(text(c), "\n"), lambda s: F.trim(s) != "")
    hits = F.size(F.filter(lines, lambda s: s.rlike(r"^[^:]{1,60}:\s+\S")))
    return (hits >= 3) & (2 * hits >= F.size(lines))


def rounded(c: Column, digits: int = 4) -> Column:
    """Half to even."""
    return F.bround(c, digits)


# The closing lines of a question to the user.
ANSWER_WITH = "Responde con una opción:"
IF_UNKNOWN = "Si no tienes el dato, responde «no sé»."


def question_prompt(label: Column, options: Column, support: Column | None = None) -> Column:
    """The node's text in bold, its boxes of support (array), the options (in line for yes and no, else numbered) and what to do without the datum, a blank line between them."""
    firsts = F.array_sort(F.transform(options, lambda o: F.substring_index(F.trim(fold(o)), " ", 1)))
    inline = F.array_join(options, " / ")
    listed = F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")
    shown = F.when(firsts == F.array(F.lit("no"), F.lit("si")), inline).otherwise(listed)
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(F.concat(F.lit("**"), label, F.lit("**"))), none if support is None else F.coalesce(support, none))
    return F.array_join(F.concat(parts, F.array(F.concat(F.lit(ANSWER_WITH + "\n"), shown), F.lit(IF_UNKNOWN))), "\n\n")
