"""Queries of the embedder, the stored indexes, the readers and the agents, with their SQL; registered beside those of the catalog."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lucerna import catalog as C
from lucerna.catalog import load, query
from lucerna.functions import text as X
from lucerna.functions import words as W
from lucerna.operators import answer as A
from lucerna.operators import embed, lineage
from lucerna.operators import flow as N
from lucerna.operators import index as I
from lucerna.operators import retrieve as R
from lucerna.operators import verify as V
from lucerna.operators.stored_index import StoredIndex
from lucerna.operators.vector_index import VectorIndex, recall
from lucerna.plans import agents as P
from lucerna.sources import files as S
from lucerna.sources import readers

# --- vectors -----------------------------------------------------------------

_EMBED = f"""etoks AS (SELECT 'd' AS kind, doc_id AS id, {C._tok('text')} AS toks FROM documents UNION ALL SELECT 'q', item_id, {C._tok('text')} FROM benchmark),
eone AS (SELECT kind, id, ('0x' || substr(md5(t), 1, 4))::BIGINT AS bucket FROM (SELECT kind, id, unnest(toks) AS t FROM etoks)),
edf AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT id) FILTER (kind = 'd') + 1)) + 1 AS idf FROM eone GROUP BY bucket),
esign AS (SELECT bucket, idf, j, 1 - 2 * ((('0x' || substr(md5('7:0:' || bucket), (1 + 8 * (j // 32))::INTEGER, 8))::BIGINT >> (j % 32)::INTEGER) & 1) AS sign FROM edf, generate_series(0, 63) g(j)),
esum AS (SELECT kind, id, j, sum(n * idf * sign) AS v FROM (SELECT kind, id, bucket, count(*) AS n FROM eone GROUP BY ALL) JOIN esign USING (bucket) GROUP BY ALL),
enorm AS (SELECT kind, id, sqrt(sum(v * v)) AS norm FROM esum GROUP BY ALL),
evec AS (SELECT kind, id, coalesce(embedding, list_transform(generate_series(0, 63), lambda j: 0.0)) AS embedding FROM etoks LEFT JOIN (SELECT kind, id, list(CASE WHEN norm > 0 THEN v / norm ELSE 0 END ORDER BY j) AS embedding FROM esum JOIN enorm USING (kind, id) GROUP BY ALL) USING (kind, id))"""


def _embedded(spark, d):
    """The model, and vectors of chunks and questions from one function."""
    chunks, asked = embed.looked_up(C._chunks(spark, d).select("chunk_id", "source_type", "text")), C._questions(spark, d)
    model = embed.fit(chunks)
    return lineage.cut(embed.vectors(chunks, model).join(chunks.select("chunk_id", "source_type"), "chunk_id")), embed.vectors(asked, model, "qid", "question").withColumnRenamed("embedding", "vector")


@query(f"WITH {_EMBED} SELECT kind, id, generate_subscripts(embedding, 1)::BIGINT - 1 AS dim, round(unnest(embedding), 6) + 0.0 AS value FROM evec")
def embedded_texts(spark, d):
    """I-Embedder: vectors of documents and of questions."""
    chunks, asked = _embedded(spark, d)
    rows = chunks.select(F.lit("d").alias("kind"), F.col("chunk_id").alias("id"), "embedding").union(asked.select(F.lit("q"), "qid", "vector"))
    return rows.select("kind", "id", F.posexplode("embedding").alias("dim", "value")).select("kind", "id", "dim", (F.round("value", 6) + 0.0).alias("value"))


_EMBEDDED = C._hybrid(
    f"{_EMBED}, asked_v AS (SELECT id AS qid, embedding FROM evec WHERE kind = 'q')",
    f"dscored AS (SELECT qid, v.id AS chunk_id, {C._OWN_SQL.replace('source', 'o.source')} AS source_type, list_sum(list_transform(generate_series(1, 64), lambda i: q.embedding[i] * v.embedding[i])) AS score FROM asked_v q, evec v JOIN documents o ON o.doc_id = v.id WHERE v.kind = 'd')",
)


@query(f"WITH {_EMBEDDED}, {C._PICKED}")
def hybrid_embedded(spark, d):
    """R9 with the vectors of the offline embedder, for every question."""
    vectors, vector = _embedded(spark, d)
    asked = C._questions(spark, d).join(vector, "qid")
    out = R.hybrid_retrieve(I.build_index(C._chunks(spark, d)), C._chunks(spark, d), vectors, asked, topics=C.TOPICS, digits=5)
    return out.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank", "method")


def _vector_index(spark, d) -> VectorIndex:
    return VectorIndex.build(C._vectors(spark, d), lineage.new_folder(spark, "vectors"))


@query()
def vector_index_topk(spark, d):
    """R3 at scale: every row whose id is divisible by 20 against all rows, by lists and codes, scored exactly at the end."""
    return _vector_index(spark, d).search(C._vector_questions(spark, d), 10, digits=5).withColumn("score", F.round("score", 5))


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS questions, 10 * count(*) FILTER (vec_id % 20 = 0) AS wanted, true AS reached FROM embeddings")
def vector_index_recall(spark, d):
    """Whether the index finds at least nine tenths of the ten nearest rows that the exact scan finds."""
    asked = C._vector_questions(spark, d)
    got = recall(_vector_index(spark, d).search(asked, 10, digits=5), R.dense_search(C._vectors(spark, d), asked, 10, digits=5))
    return got.select("questions", "wanted", (F.col("recall") >= 0.9).alias("reached"))


# --- the stored index --------------------------------------------------------


@query(f"WITH {C._BM25} {C._top('scored', 10)} AND score > 0")
def stored_index_topk(spark, d):
    """An index whose first segment has old texts for some chunks and lacks others, brought up to date by a second, then searched in part."""
    chunks = C._chunks(spark, d)
    k = F.col("chunk_id") % 50
    old = chunks.where(k != 1).withColumn("text", F.when(k == 0, F.concat(F.lit("stale words here "), F.substring("text", 1, 200))).otherwise(F.col("text")))
    gone = chunks.where(k == 2).withColumn("chunk_id", -F.col("chunk_id") - 1)
    index = StoredIndex.create(old.unionByName(gone), lineage.new_folder(spark, "index"), parts=8)
    index.upsert(chunks.where(k < 2))
    index.delete(gone.select("chunk_id"))
    return index.search(C._questions(spark, d), 10, digits=6).found.withColumn("score", F.round("score", 6))


@query(f"""WITH {C._BM25} {C._top('scored', 5, "source_type = 'institucional'")} AND score > 0""")
def merged_index_topk(spark, d):
    """Two segments merged into one, and a filter on the source after global statistics."""
    chunks = C._chunks(spark, d)
    index = StoredIndex.create(chunks.where("chunk_id % 2 = 0"), lineage.new_folder(spark, "index"), parts=8)
    index.upsert(chunks.where("chunk_id % 2 = 1"))
    index.merge()
    return index.search(C._questions(spark, d), 5, R.INSTITUTIONAL, digits=6).found.withColumn("score", F.round("score", 6))


# --- retrieval rules ---------------------------------------------------------


@query(f"""WITH {C._RANKED}, r AS (SELECT *, CASE WHEN chunk_id % 3 = 0 AND score >= 0.02 THEN 0.05 ELSE 0.0 END AS boost FROM ranked WHERE NOT (source_type <> 'institucional' AND chunk_id % 50 = 0) AND chunk_id % 3 <> 1)
SELECT qid, chunk_id, round(score + boost, 8) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score + boost, 9) DESC, chunk_id) AS rank FROM r""")
def boosted_sections(spark, d):
    """Administrative sections and first pages are excluded, numbered sections gain."""
    title = F.element_at(F.array(F.lit("4. Dosis"), F.lit("2. ALCANCE"), F.lit("Dosis")), (F.col("chunk_id") % 3 + 1).cast("int"))
    rows = C._ranked(spark, d).withColumnRenamed("score", "raw").join(C._chunks(spark, d).select("chunk_id", "page", title.alias("section")), "chunk_id")
    rows = rows.withColumn("question", F.lit("dosis"))
    return R.rerank(rows, exclude_admin=True, section_boost=0.05).select("qid", "chunk_id", F.round("score", 8).alias("score"), "rank")


_NODE_TOKS = f"list_transform(list_filter(list_filter(regexp_extract_all({C._fold('{0}')}, '[a-z0-9]+'), lambda t: NOT list_contains({C._list(W.NODE_STOP)}, t)), lambda t: length(t) > 2), lambda t: CASE WHEN t = 'pseudomonas' THEN 'aeruginosa' ELSE t END)"


@query(f"""WITH own AS (SELECT p_brand AS protocol, p_partkey AS node, {_NODE_TOKS.format('p_name || p_type')} AS toks FROM part WHERE p_size <> 1),
post AS (SELECT protocol, node, len, term, count(*) AS tf FROM (SELECT protocol, node, len(toks) AS len, unnest(toks) AS term FROM own) GROUP BY ALL),
size AS (SELECT protocol, count(*) AS n, avg(len(toks)) AS avgdl FROM own GROUP BY protocol),
raw AS (SELECT protocol, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN size USING (protocol) GROUP BY protocol, term),
idf AS (SELECT protocol, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY protocol) ELSE raw END AS idf FROM raw),
q AS (SELECT p_partkey AS qid, p_brand AS protocol, {_NODE_TOKS.format("p_type || ' ' || p_container")} AS toks FROM (SELECT *, p_name AS p_container FROM part) WHERE p_partkey % 20 = 0),
asked AS (SELECT qid, protocol, term, count(*) AS times FROM (SELECT qid, protocol, unnest(toks) AS term FROM q) GROUP BY ALL),
scored AS (SELECT qid, node, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score FROM asked JOIN post USING (protocol, term) JOIN idf USING (protocol, term) JOIN size USING (protocol) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node::VARCHAR) AS rank FROM scored) WHERE rank <= 4 AND score > 0)
SELECT qid, node::VARCHAR AS node_id, rank, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS most FROM best) WHERE score >= 0.4 * most""")
def node_ranking(spark, d):
    """Parts as nodes, a brand as a protocol with an index of its own."""
    part = load(spark, d, "part")
    nodes = part.select(F.col("p_brand").alias("protocol_id"), F.col("p_partkey").cast("string").alias("node_id"), F.when(F.col("p_size") == 1, N.START).otherwise("action").alias("kind"), F.concat("p_name", "p_type").alias("text"))
    asked = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_brand").alias("protocol_id"), F.concat("p_type", F.lit(" "), "p_name").alias("question"))
    return I.rank_nodes(nodes, asked).select("qid", "node_id", "rank", F.round("score", 6).alias("score"))


_SAID = """(SELECT conv_id AS qid, 'u' || turn AS uid, coalesce(text, '') AS text FROM conversations)"""


@query(f"""SELECT qid, 'u' || t AS uid, t::BIGINT AS pos FROM (SELECT DISTINCT conv_id AS qid, unnest([3, 1]) AS t FROM conversations WHERE conv_id % 3 <> 0)""")
def selector_replies(spark, d):
    """Ids of a reply in its order; a reply that is no JSON, or has no ids, picks nothing."""
    reply = F.when(F.col("qid") % 3 == 0, F.when(F.col("qid") % 2 == 0, "I choose u1.").otherwise('{"id": 1}')).otherwise('{"ids": ["u3", null, "u1"]}')
    rows = load(spark, d, "conversations").select(F.col("conv_id").alias("qid")).distinct()
    return A.picks(rows.withColumn("reply", reply)).select("qid", "uid", F.when(F.col("pos") == 1, 3).otherwise(1).cast("long").alias("pos"))


@query(f"""SELECT qid, uid, trim(text) AS translation FROM {_SAID} WHERE qid % 3 <> 0 AND trim(text) <> '' AND len(list_filter(regexp_extract_all({C._fold('text')}, '[a-z]+'), lambda x: list_contains({C._list(W.ENGLISH_VOTE)}, x))) > len(list_filter(regexp_extract_all({C._fold('text')}, '[a-z]+'), lambda x: list_contains({C._list(W.SPANISH_VOTE)}, x)))""")
def translator_replies(spark, d):
    """Translations of English units, the repeated id gone; unreadable replies and unknown ids leave nothing."""
    units = load(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("uid"), X.text("text").alias("unit"))
    said = F.map_from_entries(F.collect_list(F.struct("uid", F.concat(F.lit(" "), F.upper("uid"), F.lit(": "), "unit"))))
    good = F.to_json(F.struct(F.map_concat(said, F.create_map(F.lit("u999"), F.lit("x"))).alias("traducciones")))
    replies = units.groupBy("qid").agg(good.alias("reply")).withColumn("reply", F.when(F.col("qid") % 3 == 0, F.concat(F.lit("Claro: "), "reply")).otherwise(F.col("reply")))
    return A.translations(replies, units)


# --- readers -----------------------------------------------------------------


@query("""SELECT source || '-' || (doc_id // 1000) || '.txt' AS source_file, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS page, text FROM documents WHERE source NOT IN ('src0', 'src7') QUALIFY trim(coalesce(text, ''), E' \\n\\t\\r') <> ''""")
def pages_from_files(spark, d):
    """Documents written as files of pages, at most a thousand ids of a source in one, and read back, the files of two sources left out by filters that the reader takes."""
    folder = lineage.new_folder(spark, "pages")

    def write(key: tuple, pages: pa.Table) -> pa.Table:
        system, root = readers.opened(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{key[0].as_py()}-{key[1].as_py()}.txt") as f:
            f.write("\f".join(t or "" for t in pages.sort_by("doc_id")["text"].to_pylist()).encode())
        return pa.table({"source": [key[0]], "n": [pages.num_rows]})

    rows = load(spark, d, "documents").select("source", F.expr("doc_id div 1000").alias("part"), "doc_id", "text")
    lineage.cut(rows.groupBy("source", "part").applyInArrow(write, "source string, n long"))
    readers.register(spark)
    other = ~F.startswith("source_file", F.lit("src0-")) & ~F.startswith("source_file", F.lit("src7-"))
    return spark.read.format("document_pages").option("path", folder).load().where(other)


# --- agents ------------------------------------------------------------------


def _length(prompt: str) -> int:
    """The length of the question, by which the stand-ins of the models decide."""
    return len(prompt.rpartition(P.QUESTION)[2])


def _admit(prompt: str) -> str:
    return json.dumps({"ok": _length(prompt) % 9 != 0}) if _length(prompt) % 13 else "?"


def _classify(prompt: str) -> str:
    n = _length(prompt)
    return json.dumps({"protocol": "xx-pl-001" if n % 3 else "NINGUNO", "modo": "caso" if n % 3 == 1 else "consulta"})


def _extract(prompt: str) -> str:
    n = _length(prompt)
    return json.dumps({"n1": ("no", "si", "si", "quizas")[n % 4], "n3": ("", "bajo", "", "")[n % 4], "zz": "si"})


def _select(prompt: str) -> str:
    if _length(prompt) % 4 == 0:
        raise ConnectionError("no model")
    return json.dumps({"nodos": ["zz", "n6", "n0", "n6"]}) if _length(prompt) % 4 == 1 else "none"


def _generate(prompt: str) -> str:
    n = _length(prompt)
    if n % 7 == 0:
        raise ConnectionError("no model")
    sure = n % 5 != 0 or (P.EXTRA in prompt and n % 10 != 0)
    return f"{'Dato' if sure else 'Probablemente'} {re.search(r'\[Guia: [^]]*]', prompt)[0]}"


def _evaluate(prompt: str) -> str:
    return "?" if _length(prompt) % 11 == 0 else json.dumps({"ok": True})


def _relate(prompt: str) -> str:
    return json.dumps({"relacionada": _length(prompt) % 2 == 0})


_FACTS = f"""{C._BM25}, asked_n AS (SELECT item_id AS qid, length(text) AS n FROM benchmark), top1 AS ({C._top('scored', 1)} AND score > 0),
facts AS (SELECT a.qid, n, n % 9 = 0 AND n % 13 <> 0 AS rejected, '[Guia: ' || d.source || ', Seccion: Sin seccion, Pagina: ' || (d.doc_id % 50 + 1) || ']' AS cite FROM asked_n a LEFT JOIN top1 t USING (qid) LEFT JOIN documents d ON d.doc_id = t.chunk_id),
rag AS (SELECT *, cite IS NOT NULL AND n % 7 = 0 AS rag_failed, cite IS NOT NULL AND n % 7 <> 0 AND n % 5 = 0 AS again FROM facts),
rag2 AS (SELECT *, CASE WHEN rag_failed THEN NULL WHEN again AND n % 10 = 0 THEN 'rechazada_por_evaluador' WHEN n % 11 = 0 THEN 'no_verificable' ELSE 'verificada' END AS rag_v FROM rag),
tree AS (SELECT *, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN CASE n % 4 WHEN 0 THEN 'Recorrido del árbol clínico XX-PL-001 v03:' || chr(10) || chr(10) || '- Fever? → **no**' || chr(10) || '- End' WHEN 1 THEN 'Recorrido del árbol clínico XX-PL-001 v03:' || chr(10) || chr(10) || '- Fever? → **si**' || chr(10) || '- Measure with device' || chr(10) || '- Risk? → **bajo**' || chr(10) || '- Home' || chr(10) || '- End' END
  WHEN n % 4 = 1 THEN 'Ramas del árbol clínico XX-PL-001 v03 relacionadas con la consulta:' || chr(10) || chr(10) || '- End' ELSE 'Inicio del árbol clínico XX-PL-001 v03, en el orden del recorrido:' || chr(10) || chr(10) || '- Fever? → si / no' || chr(10) || '- Measure with device' || chr(10) || '- End' || chr(10) || '- Risk? → alto + device / bajo' || chr(10) || '- Ward' || chr(10) || '- Home' END AS content FROM rag2),
tree2 AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'sin_protocolo' WHEN content IS NULL THEN 'informacion_faltante' ELSE 'resultado' END AS tree_s, CASE WHEN content IS NULL THEN NULL WHEN (n % 3 = 2 AND n % 4 = 1) OR n % 2 = 0 THEN 'verificada' ELSE 'no_relacionada' END AS tree_v, CASE WHEN rag_v = 'verificada' THEN 'Dato ' || cite END AS said FROM tree)"""


@query(f"""WITH {_FACTS} SELECT qid, CASE WHEN rejected THEN 'fuera' WHEN tree_v = 'verificada' AND said IS NOT NULL THEN '**Arbol de decision**' || chr(10) || content || chr(10) || chr(10) || '**Documentos**' || chr(10) || said WHEN tree_v = 'verificada' THEN content WHEN said IS NOT NULL THEN said ELSE '{W.REFUSAL_TEXT}' END AS text,
CASE WHEN rejected THEN 0 ELSE (tree_v IS NOT DISTINCT FROM 'verificada')::BIGINT + (said IS NOT NULL)::BIGINT END AS n_blocks, CASE WHEN NOT rejected THEN tree_s END AS tree_status, CASE WHEN NOT rejected THEN tree_v END AS tree_verification,
CASE WHEN rejected THEN NULL WHEN rag_failed THEN 'error_tecnico' ELSE 'resultado' END AS rag_status, CASE WHEN NOT rejected THEN rag_v END AS rag_verification, CASE WHEN NOT rejected THEN again::BIGINT END AS retry_count, CASE WHEN rag_failed AND NOT rejected THEN 'error_tecnico: no model' END AS rag_error FROM tree2""")
def agentic_questions(spark, d):
    """Every question through both agents: models stand in that reject, fail, cannot be read, and answer well only at the second pass."""
    chunks, asked = C._chunks(spark, d), C._questions(spark, d)
    index = I.build_index(chunks)
    heads, nodes, edges = S.tree_tables(spark, [C.TREE])
    trees = P.Trees(heads.withColumns({"source_file": F.lit("XX-PL-001_v03.pdf"), "terms": F.array(F.lit("fever"))}), nodes, edges)

    def retrieve(questions):
        best = I.bm25_search(index, questions, 3, digits=6)
        return chunks.join(I.small(lineage.cut(best.select("qid", "chunk_id", "rank"))), "chunk_id")

    models = P.Models(_admit, _classify, _extract, _select, _generate, _evaluate, _relate)
    return P.agents(asked, trees, retrieve, models, "fuera").drop("tree_error")
