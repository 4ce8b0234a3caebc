"""More queries with their SQL: cleaning rules, units and answers, graphs, publication rules; registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.catalog import _ROUTES, _first, _fold, _graph, _list, _re2, load, query
from lucerna.functions import text as X
from lucerna.functions import words as W
from lucerna.operators import answer as A
from lucerna.operators import evaluate as E
from lucerna.operators import flow as N
from lucerna.operators import ingest as G
from lucerna.operators import lineage
from lucerna.operators import verify as V
from lucerna.sources import files as S

# --- cleaning ----------------------------------------------------------------

_LINE = "split_part(coalesce(text, ''), chr(10), 1)"


def _first_line(c: str = "text"):
    return F.split(X.text(c), "\n")[0]


@query(f"""SELECT doc_id, trim(regexp_replace(t, '[*_]+', '', 'g')) AS plain, rtrim(trim(regexp_replace(t, '[*_]+', '', 'g')), ' :.') AS title, doc_id % 2 = 0 AS upper_title,
CASE WHEN length(t) > 40 THEN rtrim(regexp_replace(substr(t, 1, 40), '\\s+\\S*$', '')) || '…' ELSE t END AS short, doc_id % 3 = 0 AS numbered
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '**CAPITULO ' || doc_id || ': **' WHEN doc_id % 3 = 0 THEN '_' || doc_id % 100 || '. ¿x' || translate({_LINE}, '*_¿?', '') || '?_' ELSE '**x' || translate({_LINE}, '*_¿?', '') || '. **' END AS t FROM documents)
WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 = 0) UNION ALL SELECT doc_id, 'CAPITULO ' || doc_id || ':', 'CAPITULO ' || doc_id, true, '**CAPITULO ' || doc_id || ': **', false FROM documents WHERE doc_id % 6 = 0""")
def title_rules(spark, d):
    """F7, F8, F14, F15, F16."""
    k, line = F.col("doc_id"), F.translate(_first_line(), "*_¿?", "")
    number = lambda c: c.cast("string")
    t = F.when(k % 2 == 0, F.concat(F.lit("**CAPITULO "), number(k), F.lit(": **"))).when(k % 3 == 0, F.concat(F.lit("_"), number(k % 100), F.lit(". ¿x"), line, F.lit("?_"))).otherwise(F.concat(F.lit("**x"), line, F.lit(". **")))
    rows = load(spark, d, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", X.strip_emphasis("t").alias("plain"), X.clean_title("t").alias("title"), X.is_upper_title("t").alias("upper_title"), X.short_title("t", 40).alias("short"), X.is_numbered_question("t").alias("numbered"))


_PIPED = "(SELECT doc_id, '| a | b |' || chr(10) || replace(coalesce(text, ''), '. ', ' |' || chr(10) || ' | ') AS text FROM documents)"


@query(f"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT (starts_with(trim(s, E' \\t\\r'), '|') AND ends_with(trim(s, E' \\t\\r'), '|') AND length(trim(s, E' \\t\\r')) > 1)), chr(10)) AS text FROM {_PIPED}")
def stripped_tables(spark, d):
    """F12."""
    text = F.concat(F.lit("| a | b |\n"), F.replace(X.text("text"), F.lit(". "), F.lit(" |\n | ")))
    return load(spark, d, "documents").select("doc_id", X.strip_tables(text).alias("text"))


#: What an extractor leaves at the top of a page; of it only the last line is text.
_HEAD = """<!-- Start of picture text -->
x <br>
y
<!-- End of picture text -->
**Gráfico 1.** Etiología
**FIGURA 2** x
Descargado para Ana Ruiz (ana.ruiz@example.org) de Y
Copyright. For personal use only.
_El contenido de este documento es de propiedad y de uso exclusivo de la Casa Ñandú._
**Cualquier impresión o copia tomada de este documento se considera como COPIA NO CONTROLADA**
** Página 3 de 12 **
Ver https://example.org: la <mark>dosis</mark> es 5 mg
"""


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace('Ver https://example.org: la dosis es 5 mg' || chr(10) || array_to_string(list_transform(list_filter(string_split(x, chr(10)), lambda s: NOT regexp_matches(s, '{_re2(W.STAMP_LINE)}')), lambda s: CASE WHEN regexp_matches(s, '^[\s*_-]*$') THEN '' ELSE regexp_replace(s, '\s+$', '') END), chr(10)) || repeat(chr(10), 6) || 'End', '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text
FROM (SELECT doc_id, replace(coalesce(text, ''), '. ', '.') AS x FROM documents)""")
def cleaned_pages(spark, d):
    """pictures' text and captions, stamps and boilerplate go; a line with an address of a page stays."""
    text = F.concat(F.lit(_HEAD), F.replace(X.text("text"), F.lit(". "), F.lit(".<br>")), F.lit("\n\n\n\n****\n \nEnd"))
    return load(spark, d, "documents").select("doc_id", X.clean_page(text).alias("text"))


@query(rf"SELECT doc_id, trim(regexp_replace(translate({_LINE}, '*_#[]•➢▪◦.', ''), '\s+', ' ', 'g')) || '. a b.' AS unit FROM documents WHERE trim(translate({_LINE}, '*_#[]•➢▪◦.', '')) <> ''")
def clean_units(spark, d):
    """F18."""
    plain = F.translate(_first_line(), "*_#[]•➢▪◦.", "")
    rows = load(spark, d, "documents").where(F.trim(plain) != "")
    return rows.select("doc_id", X.clean_unit(F.concat(F.lit("**"), F.trim(plain), F.lit("** [3, 4]. . a  •  b. The correct answer is (C)."))).alias("unit"))


@query("SELECT doc_id, hits >= 3 AND 2 * hits >= n AS block FROM (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda s: regexp_matches(s, '^[^:]{1,60}:\\s+\\S'))) AS hits FROM (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), ' a', ': a'), chr(10)), lambda s: trim(s) <> '') AS l FROM documents))")
def key_value_blocks(spark, d):
    """A9."""
    return load(spark, d, "documents").select("doc_id", X.is_key_value_block(F.replace(X.text("text"), F.lit(" a"), F.lit(": a"))).alias("block"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'CT-PL-' || (100 + o_orderkey % 900) ELSE 'guia ' || o_orderkey END AS document, 'v' || lpad((o_orderkey % 120)::VARCHAR, greatest(2, length((o_orderkey % 120)::VARCHAR))::INTEGER, '0') AS version,
o_orderpriority || ' x' AS head, o_orderpriority AS qualifier, 'a &lt; ' || o_orderpriority || ' &amp; b' AS html, CASE o_orderkey % 3 WHEN 0 THEN 'Protocolo institucional' WHEN 1 THEN 'Guia clinica' ELSE 'otro' END AS label,
'(' || o_orderkey || ') [Guia: f, Seccion: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ', Pagina: ' || o_orderkey % 7 ELSE '' END || ']' || chr(10) || 'body' AS block, 'a' || chr(10) || '  ' || o_orderpriority AS indented, 'a' || chr(10) || o_orderpriority AS lines FROM orders""")
def small_texts(spark, d):
    """F28, F29, F31 to F35, F37."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    name = F.when(k % 2 == 0, F.concat(F.lit(" ct-pl-"), (100 + k % 900).cast("string"), F.lit("_Protocolo v3.pdf"))).otherwise(F.concat(F.lit(" Guia "), k.cast("string"), F.lit(" ")))
    kind = F.element_at(F.array(F.lit("institucional"), F.lit("guia"), F.lit("otro")), (k % 3 + 1).cast("int"))
    cite = X.citation(F.lit("f"), p, F.when(k % 2 == 0, k % 7))
    shown = {
        "document": X.document_key(name), "version": X.version_label(F.concat(F.lit("version "), (k % 120).cast("string"))),
        "head": X.headline(F.concat(p, F.lit("\nx\n• y\n• z"))), "qualifier": X.qualifier(F.concat(F.lit("alto + "), p, F.lit(" "))),
        "html": X.html_escape(F.concat(F.lit("a < "), p, F.lit(" & b"))), "label": X.source_label(kind), "block": X.context_block(k, cite, F.lit("body")),
        "indented": X.indent(F.concat(F.lit("a\n"), p)), "lines": X.drop_blank_lines(F.concat(F.lit("a\n \n\n"), p, F.lit("\n"))),
    }
    return load(spark, d, "orders").select(k.alias("k"), *(c.alias(n) for n, c in shown.items()))


_TOKS = f"list_filter(list_filter(regexp_extract_all({_fold('p_name')}, '[a-z0-9]+'), lambda t: NOT list_contains({_list(W.NODE_STOP)}, t)), lambda t: length(t) > 2)"


@query(f"SELECT p_partkey, array_to_string(list_transform({_TOKS}, lambda t: CASE WHEN t IN ('blue', 'azure') THEN 'sky' ELSE t END), ' ') AS tokens FROM part")
def node_words(spark, d):
    """F36."""
    return lineage.spread(load(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", F.array_join(X.node_tokens("p_name", {"blue": "sky", "azure": "sky"}), " ").alias("tokens"))


@query("""SELECT o_orderkey AS k, '**' || o_orderpriority || '?**' || chr(10) || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || chr(10) || chr(10) || 'box' || chr(10) || chr(10) ELSE '' END || 'Responde con una opción:' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'Sí — ' || o_orderstatus || ' / No' ELSE '1. ' || o_orderpriority || chr(10) || '2. otro' END || chr(10) || chr(10) || 'Si no tienes el dato, responde «no sé».' AS prompt FROM orders""")
def question_prompts(spark, d):
    """The node's text, its boxes of support, the options, and what to do without the datum."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    options = F.when(k % 2 == 0, F.array(F.concat(F.lit("Sí — "), status), F.lit("No"))).otherwise(F.array(F.col("o_orderpriority"), F.lit("otro")))
    boxes = F.when(k % 3 == 0, F.array(status, F.lit("box")))
    return load(spark, d, "orders").select(k.alias("k"), X.question_prompt(F.concat("o_orderpriority", F.lit("?")), options, boxes).alias("prompt"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round_even(l_partkey / 8.0, 2) AS score, coalesce(nullif(l_returnflag, 'N'), 'none') AS flag, 'institucional' AS source_type FROM lineitem")
def payload_defaults(spark, d):
    """P2, P4."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.rounded(F.col("l_partkey") / F.lit(8.0), 2).alias("score"), F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return G.with_defaults(rows, {"flag": "none", "source_type": "institucional"})


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 'institucional' WHEN 'src2' THEN 'guia' END AS source_type, CASE source WHEN 'src1' THEN 'One' WHEN 'src2' THEN 'Src 2.pdf' END AS source_title FROM documents")
def catalogued(spark, d):
    """Names meet by their letters and digits, escapes decoded."""
    known = spark.createDataFrame([("SRC_1.pdf", "institucional", "One"), ("Src 2.pdf", "guia", None)], "file string, source_type string, title string")
    name = F.concat(F.replace("source", F.lit("src"), F.lit("#U0053rc-")), F.lit(".PDF"))
    rows = load(spark, d, "documents").select("doc_id", name.alias("source_file"))
    return G.tagged(rows, known, strict=False).select("doc_id", "source_type", "source_title")


@query("SELECT count(*) FILTER (source IN ('src0', 'src1', 'src2')) AS own, count(*) FILTER (source NOT IN ('src0', 'src1', 'src2')) AS outside FROM documents")
def chunks_by_kind(spark, d):
    """A11."""
    from lucerna.catalog import _chunks

    return G.by_kind(_chunks(spark, d))


_DULL = W.META[0]


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '{_DULL}? {_DULL}?' WHEN p_partkey % 3 = 1 THEN p_name || '?' ELSE p_name || '? ' || p_type || ' zinc?' END AS query FROM part")
def sub_questions(spark, d):
    """parts without a word of substance go; all stay if none has one."""
    k, name = F.col("p_partkey"), F.col("p_name")
    asked = F.when(k % 3 == 0, f"{_DULL}? {_DULL}?").when(k % 3 == 1, F.concat(F.lit(f"{_DULL}? "), name, F.lit("?"))).otherwise(F.concat(name, F.lit("? "), F.lit(f"{_DULL}? "), F.col("p_type"), F.lit(" zinc?")))
    return lineage.spread(load(spark, d, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", X.retrieval_query(asked).alias("query"))


@query("""SELECT p_partkey, p_name || '. x' AS tidied, 'Use ' || p_name || ' in adults now.' AS without_references, p_name || ' is used here.' AS whole, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name || ' doi' END AS cited,
p_partkey % 5 < 4 AS unusable, p_partkey % 2 = 0 AS study FROM part""")
def external_units(spark, d):
    """Numbers and marks of calls, references, unfinished ends, lists of abbreviations, attributions, fragments, summaries of studies."""
    k, name = F.col("p_partkey"), F.col("p_name")
    whole = F.concat(F.lit("We recommend the "), name, F.lit(" for all adults with a severe infection and for those who do not improve in two days."))
    kinds = (F.concat(F.lit("AB = alpha, CD = beta, EF = gamma and "), whole), F.lit("Adapted from another text of ours."), F.concat(name, F.lit(" with")), F.concat(F.lit("Dose = "), whole), whole)
    unit = F.element_at(F.array(*kinds), (k % 5 + 1).cast("int"))
    cited = F.when(k % 2 == 0, F.concat(F.when(k % 4 == 0, "Muñoz LE, ").otherwise("Smith JA, "), name, F.lit(" et al. 2020"))).otherwise(F.concat(name, F.lit(" doi")))
    shown = {
        "tidied": X.tidy_external(F.concat(F.lit("_"), name, F.lit(" 12 13 . x†"))),
        "without_references": X.strip_references(F.concat(F.lit("Use "), name, F.lit(" in adults now. Muñoz JA, et al. doi:10"))),
        "whole": X.trim_tail(F.concat(name, F.lit(" is used here. And then the"))),
        "cited": X.strip_references(cited), "unusable": X.unusable_external(unit),
        "study": X.is_study_summary(F.when(k % 2 == 0, F.concat(F.lit("El estudio de Lopez con "), name)).otherwise(name)),
    }
    return lineage.spread(load(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", *(c.alias(n) for n, c in shown.items()))


@query("SELECT p_type AS protocol, max(p_name) AS version, arg_max(k, p_name) AS path FROM (SELECT p_type, p_name, min(p_partkey) AS k FROM part GROUP BY ALL) GROUP BY p_type")
def newest_files(spark, d):
    """S6."""
    files = load(spark, d, "part").groupBy(F.col("p_type").alias("protocol"), F.col("p_name").alias("version")).agg(F.min("p_partkey").alias("path"))
    return S.newest_versions(files)


# --- units and answers -------------------------------------------------------

# Line items as units: an order asks, a line is a unit, returned ones are the house's own.
_UNITS = "units AS (SELECT l_orderkey AS qid, 'u' || l_linenumber AS uid, l_linenumber::BIGINT AS rank, l_linenumber::BIGINT AS ord, CASE WHEN l_returnflag = 'R' THEN 'institucional' ELSE 'guia' END AS source_type, max(l_quantity) AS fit, 'f' || max(l_suppkey) % 3 AS source_file, max(l_partkey) % 5 AS page, max(l_partkey) AS chunk_index FROM lineitem GROUP BY ALL)"


def _units(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "institucional").otherwise("guia")
    rows = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", kind.alias("source_type")).agg(F.max("l_quantity").alias("fit"), F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("p"))
    line = F.col("l_linenumber").cast("long")
    return rows.select(F.col("l_orderkey").alias("qid"), F.concat(F.lit("u"), line.cast("string")).alias("uid"), line.alias("rank"), line.alias("ord"), "source_type", "fit", F.concat(F.lit("f"), (F.col("s") % 3).cast("string")).alias("source_file"), (F.col("p") % 5).alias("page"), F.col("p").alias("chunk_index"), F.lit("s").alias("section"), F.concat(F.lit("line "), line.cast("string")).alias("unit"))


@query(f"""WITH {_UNITS}, n AS (SELECT *, source_type = 'institucional' AS own, row_number() OVER (PARTITION BY qid, source_type ORDER BY round(fit, 9) DESC, rank, ord) AS nth FROM units WHERE fit > 0),
room AS (SELECT qid, CASE WHEN bool_or(source_type <> 'institucional') THEN 2 ELSE 3 END AS limit_ FROM units GROUP BY qid),
own AS (SELECT n.qid, uid, source_type FROM n JOIN room ON room.qid = n.qid WHERE own AND nth <= limit_), taken AS (SELECT qid, count(*) AS taken FROM own GROUP BY qid)
SELECT qid, uid, source_type FROM own UNION ALL SELECT n.qid, uid, source_type FROM n LEFT JOIN taken ON taken.qid = n.qid WHERE NOT own AND nth <= 3 - coalesce(taken, 0)""")
def unit_shares(spark, d):
    """The house's own first, at most half of three, rounded up, if there are others."""
    return A.select_units(_units(spark, d), 3).select("qid", "uid", "source_type")


@query(f"WITH {_UNITS} SELECT qid, uid, min(pos)::BIGINT AS pos FROM (SELECT qid, uid, source_type, unnest(CASE WHEN uid = 'u1' THEN [2, 4] WHEN uid = 'u3' THEN [1] ELSE [] END) AS pos FROM units) GROUP BY ALL")
def picked_units(spark, d):
    """u3, u1, a number nobody has, u1 again."""
    rows = _units(spark, d)
    picks = rows.select("qid").distinct().select("qid", F.posexplode(F.array(*map(F.lit, ("u3", "u1", "u99", "u1")))).alias("at", "uid")).select("qid", (F.col("at") + 1).alias("pos"), "uid")
    return A.chosen_units(rows, picks).select("qid", "uid", "pos").distinct()


@query("SELECT doc_id AS qid, bool_and(score < 0.05) AS gated, count(*) FILTER (best >= 0.05) AS kept FROM (SELECT l_orderkey AS doc_id, l_discount AS score, max(l_discount) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) GROUP BY doc_id")
def gated_questions(spark, d):
    """P12, A5."""
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_discount").alias("score"))
    kept = A.relevance_gate(rows, 0.05).groupBy("qid").agg(F.count("*").alias("kept"))
    return rows.select("qid").distinct().join(kept, "qid", "left").select("qid", F.col("kept").isNull().alias("gated"), F.coalesce("kept", F.lit(0)).alias("kept"))


_CITE = "'[Guia: ' || source_file || ', Seccion: s, Pagina: ' || page || ']'"


@query(f"""WITH {_UNITS}, lines AS (SELECT *, '- ' || CASE WHEN rank % 2 = 0 THEN 'translated (traducido del inglés)' ELSE 'line ' || rank END || ' ' || {_CITE} AS line, source_type = 'institucional' AS own FROM units)
SELECT qid, string_agg(line, chr(10) ORDER BY NOT own, CASE WHEN own THEN source_file ELSE '' END, CASE WHEN own THEN page ELSE rank END, CASE WHEN own THEN chunk_index ELSE 0 END, ord, line) AS answer FROM lines GROUP BY qid""")
def composed_answers(spark, d):
    """Even lines come translated, odd ones keep the original."""
    rows = _units(spark, d)
    said = rows.where("rank % 2 = 0").select("qid", "uid", F.concat("uid", F.lit(": **translated** [3]")).alias("translation")).distinct()
    return A.compose(rows, said)


@query(f"""WITH {_UNITS}, own AS (SELECT * FROM units WHERE source_type = 'guia') SELECT qid, string_agg('(' || rank || ') ' || {_CITE} || chr(10) || 'line ' || rank, chr(10) || chr(10) ORDER BY rank, {_CITE}) AS context FROM own GROUP BY qid""")
def context_blocks(spark, d):
    """X9, F35."""
    return A.context(_units(spark, d).where("source_type = 'guia'").withColumnRenamed("unit", "text"))


@query(f"""WITH {_UNITS}, u AS (SELECT qid, rank, min(uid) AS uid, min(source_file) AS source_file, min(page) AS page FROM units GROUP BY qid, rank),
c AS (SELECT *, '[Guia clinica | ' || source_file || ' | s | p. ' || page || ']' AS cite FROM u), l AS (SELECT *, lag(cite) OVER (PARTITION BY qid ORDER BY rank) AS last FROM c)
SELECT qid, 'PREGUNTA:' || chr(10) || 'Order ' || qid || '?' || chr(10) || chr(10) || 'ORACIONES:' || chr(10) || string_agg(CASE WHEN last IS DISTINCT FROM cite THEN cite || chr(10) ELSE '' END || '  ' || uid || ': line ' || rank, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'INSTRUCCION ADICIONAL:' || chr(10) || 'literal' AS prompt FROM l GROUP BY qid""")
def selector_prompts(spark, d):
    """the question, a header only where the source changes, the instruction."""
    rows = _units(spark, d).groupBy("qid", "rank", "ord", "unit", "section").agg(F.min("uid").alias("uid"), F.min("source_file").alias("source_file"), F.min("page").alias("page")).withColumn("source_type", F.lit("guia"))
    asked = rows.select("qid").distinct().withColumn("question", F.concat(F.lit("Order "), F.col("qid").cast("string"), F.lit("?")))
    return A.selector_prompt(rows, asked, "literal")


@query("""SELECT o_orderkey AS qid, CASE o_orderkey % 4 WHEN 0 THEN 'own a' || chr(10) || chr(10) || 'outside' WHEN 1 THEN 'outside' WHEN 2 THEN 'own a' ELSE 'No encuentro eso.' END AS answer FROM orders""")
def merged_sources(spark, d):
    """Both, one, the other, neither."""
    k, no = F.col("o_orderkey") % 4, F.lit("No encuentro eso.")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), A.by_source(F.when(k.isin(0, 2), "own a[1, 2]").otherwise(no), F.when(k < 2, "outside").otherwise(no)).alias("answer"))


@query("""WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index FROM documents), t AS (SELECT source, l, n FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (VALUES ('a', 0), ('a', 1), ('b', 0)) v(l, n))
SELECT source AS source_file, chunk_index, doc_id::VARCHAR AS text FROM c UNION ALL SELECT t.source, m.n + row_number() OVER (PARTITION BY t.source ORDER BY l, t.n) - 1, l || t.n FROM t JOIN (SELECT source, count(*) AS n FROM c GROUP BY source) m ON m.source = t.source""")
def appended_rows(spark, d):
    """Rows of tables go on after the chunks of their document."""
    docs = load(spark, d, "documents")
    place = F.row_number().over(F_window("source", "doc_id")) - 1
    chunks = docs.select(F.col("source").alias("source_file"), place.alias("chunk_index"), F.col("doc_id").cast("string").alias("text"), F.lit("s").alias("section"), F.lit("x").alias("chunk_id"))
    three = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(n).alias("row_index")) for s, n in (("b", 0), ("a", 1), ("a", 0))))
    rows = docs.select(F.col("source").alias("source_file")).distinct().select("source_file", F.inline(three)).withColumn("text", F.concat("section", F.col("row_index").cast("string")))
    return G.append_rows(chunks, rows).select("source_file", "chunk_index", "text")


def F_window(by: str, order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(by).orderBy(order)


# --- graphs and publication --------------------------------------------------

# All edges between parts, references (to every fifth part) among them.
_EDGES = "edges AS (SELECT a.p_partkey AS s, b.p_partkey AS t, k.k AS pos FROM part a CROSS JOIN (VALUES (0), (1), (2)) k(k) JOIN part b ON b.p_partkey = CASE k.k WHEN 0 THEN 2 * a.p_partkey WHEN 1 THEN 2 * a.p_partkey + 1 ELSE 3 * a.p_partkey END)"


@query(f"""WITH {_EDGES}, ways AS (SELECT s, count(*) AS n FROM edges WHERE t % 5 <> 0 AND pos <> 2 GROUP BY s)
SELECT 'P' AS protocol_id, 'dead decision: ' || p_partkey AS problem FROM part LEFT JOIN ways ON s = p_partkey WHERE p_partkey % 2 = 0 AND coalesce(n, 0) < 2
UNION ALL SELECT DISTINCT 'P', 'unknown node: x' || s FROM edges WHERE s % 50 = 0 AND pos = 0""")
def graph_problems(spark, d):
    """References and edges of context are no ways out; every fiftieth node has an edge to nowhere."""
    nodes, edges = _graph(spark, d)
    label = F.when(F.col("edge_pos") == 2, N.CONTEXT_LABELS[0]).otherwise(F.col("label"))
    lost = edges.where("edge_pos = 0 AND CAST(source AS LONG) % 50 = 0").withColumn("target", F.concat(F.lit("x"), "source")).withColumn("reference", F.lit(True))
    every = edges.withColumn("label", label).withColumn("reference", F.col("target").cast("long") % 5 == 0)
    return N.problems(nodes, every.unionByName(lost))


@query(f"WITH {_EDGES} SELECT t::VARCHAR AS node_id, s::VARCHAR AS support_id, 0::BIGINT AS way FROM edges WHERE t % 5 = 0 UNION ALL SELECT s::VARCHAR, t::VARCHAR, 1 FROM edges WHERE pos = 2")
def graph_support(spark, d):
    """References into a node, and what its edges of context lead to."""
    nodes, edges = _graph(spark, d)
    label = F.when(F.col("edge_pos") == 2, N.CONTEXT_LABELS[0]).otherwise(F.col("label"))
    every = edges.withColumn("label", label).withColumn("reference", F.col("target").cast("long") % 5 == 0)
    return N.support(every, nodes).select("node_id", "support_id", F.col("pos")["col1"].alias("way"))


_BEST = f"WITH RECURSIVE {_ROUTES}, best AS (SELECT node, depth, trail FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, trail) AS n FROM walk) WHERE n = 1 AND node <> 1)"


@query(f"{_BEST} SELECT node::VARCHAR AS node_id, row_number() OVER (ORDER BY depth, trail) - 1 AS pos FROM best WHERE node % 2 = 0")
def decision_order(spark, d):
    """N8."""
    nodes, edges = _graph(spark, d)
    return N.decisions_in_order(N.routes(edges, _first(nodes, "1")), nodes).select("node_id", "pos")


@query(f"{_BEST} SELECT node_id, pos FROM (SELECT node, node::VARCHAR AS node_id, row_number() OVER (ORDER BY depth, trail) AS pos FROM best) WHERE node % 3 = 1")
def first_sections(spark, d):
    """The nodes of the start's section, in the order of a walk."""
    nodes, edges = _graph(spark, d)
    nodes = nodes.withColumn("section", F.concat(F.lit("s"), (F.col("node_id").cast("long") % 3).cast("string")))
    return N.first_section(N.routes(edges, _first(nodes, "1")).drop("path"), nodes).select("node_id", F.col("_n").alias("pos"))


@query("""SELECT doc_id AS qid, CASE WHEN toxic = 1 THEN 'rejected' WHEN doc_id % 3 = 0 THEN 'both' WHEN quality = 1 THEN 'answer' ELSE 'none' END AS text, CASE WHEN doc_id % 4 = 0 THEN 'could not check for contradictions' WHEN doc_id % 4 = 1 THEN 'the contributions contradict each other' END AS note,
CASE WHEN toxic = 1 THEN 'citas_incompletas' WHEN doc_id % 5 = 0 THEN 'verificada' WHEN doc_id % 4 = 0 THEN 'no_verificable' WHEN doc_id % 4 = 1 THEN 'verificada' ELSE 'no_relacionada' END AS verification,
toxic = 0 AND (doc_id % 5 = 0 OR doc_id % 4 = 1) AS eligible FROM labels""")
def publication(spark, d):
    """What is published, the note on contradictions, and whether a walk fits the question."""
    k, bad = F.col("doc_id"), F.col("toxic") == 1
    judge = F.when(k % 4 == 0, F.lit(None).cast("boolean")).otherwise(k % 4 == 1)
    tree = F.struct(F.lit("resultado").alias("status"), F.when(bad, "citas_incompletas").otherwise(V.VERIFIED).alias("verification"), (~bad).alias("eligible"))
    fits = V.related(tree, judge, k % 5 == 0)
    said = V.final_text(F.when(bad, "rejected"), F.when(k % 3 == 0, "both"), F.lit("answer"), F.when(F.col("quality") == 1, V.APPROVED).otherwise(V.REJECTED), "none")
    rows = load(spark, d, "labels").select(k.alias("qid"), said.alias("text"), V.contradiction(judge).alias("note"), fits.alias("t"))
    return rows.select("qid", "text", "note", F.col("t.verification").alias("verification"), F.col("t.eligible").alias("eligible"))


@query("SELECT doc_id AS qid FROM labels WHERE quality = 0 AND doc_id % 2 = 0 AND toxic = 0")
def retries(spark, d):
    """O2: rejected, not retried yet, no error."""
    rows = load(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.when(F.col("quality") == 1, V.APPROVED).otherwise(V.REJECTED).alias("eval_status"), (F.col("doc_id") % 2).alias("retry_count"), F.when(F.col("toxic") == 1, "boom").alias("error"))
    return V.retry_rows(rows).select("qid")


@query("""SELECT 'faithfulness' AS metric, count(quality) AS n, avg(quality::DOUBLE) AS mean FROM labels UNION ALL SELECT 'answer_relevancy', count(toxic), avg(toxic::DOUBLE) FROM labels UNION ALL SELECT 'context_precision', count(*) FILTER (doc_id % 2 = 0), avg(CASE WHEN doc_id % 2 = 0 THEN 0.5 END) FROM labels""")
def judge_means(spark, d):
    """E4, A14."""
    return E.judge_metrics(load(spark, d, "labels").select(F.col("quality").alias("faithfulness"), F.col("toxic").alias("answer_relevancy"), F.when(F.col("doc_id") % 2 == 0, 0.5).alias("context_precision")))
