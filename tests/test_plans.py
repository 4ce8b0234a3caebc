"""The embedder, stored indexes, range scans, readers, streams and agents: against plain versions and planted cases."""

import json
import math
import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna import catalog, catalog_rules  # noqa: F401  registers its queries
from lucerna.functions import text as X
from lucerna.functions import words as W
from lucerna.operators import answer as A
from lucerna.operators import embed, scan
from lucerna.operators import evaluate as E
from lucerna.operators import flow as N
from lucerna.operators import index as I
from lucerna.operators import ingest as G
from lucerna.operators import retrieve as R
from lucerna.operators import segment
from lucerna.operators import verify as V
from lucerna.operators.stored_index import StoredIndex
from lucerna.operators.vector_index import VectorIndex, recall
from lucerna.plans import agents as P
from lucerna.plans.engine import Engine
from lucerna.sources import files as S
from lucerna.sources import readers


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


# --- text


def test_fold_of_every_code_point(spark):
    # code points that one side does not know yet are left out
    points = [c for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    plain = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(x))
    rows = spark.createDataFrame([(f"a{chr(c)}b",) for c in points], "s string").repartition(8)
    wrong = [r.s for r in rows.withColumn("f", X.fold("s")).collect() if r.f != plain(r.s)]
    assert wrong == []
    assert one(spark, X.tokens("s"), s="Őrǎbc ﬁn") == ["orabc", "fin"]


def test_pages_in_the_extractors_format(spark):
    head = catalog.QUERIES and __import__("lucerna.catalog_rules", fromlist=["_HEAD"])._HEAD
    assert one(spark, X.clean_page("s"), s=head + "Texto\n\n\n\n_ *\nEnd  ") == "Ver https://example.org: la dosis es 5 mg\nTexto\n\nEnd"
    assert one(spark, X.clean_page("s"), s="tel: 5\r\nx<sup>2</sup>\u2028y\n**GRÁFICO 3** z") == "tel: 5\nx2\ny"
    assert one(spark, X.strip_references("s"), s="Use this drug in adults now. Muñoz LE, Gupta K, et al.") == "Use this drug in adults now."
    assert one(spark, F.lit("GRÁFICO 1. Etiología de todo").rlike(segment.CAPTION))
    assert [one(spark, X.is_numbered_question("s"), s=s) for s in ("3. ¿Qué hacer", "3. Qué hacer?", "3. Qué? hacer")] == [True, True, False]


def test_talk_of_other_sources(spark):
    said = {"otras guías dicen": True, "no hay otras guias": False, "no existen en esto otras fuentes": False, "no se sabe si otras fuentes": True, "sin otras guias, y algunas fuentes lo dicen": True, "las fuentes coinciden": True, "no hay ambas guias": True, "nada": False}
    assert {s: one(spark, X.mentions_others("s", F.lit(1)), s=s) for s in said} == said
    assert one(spark, X.mentions_others("s", F.lit(0)), s="otras guias") and not one(spark, X.mentions_others("s", F.lit(2)), s="otras guias")


def test_versions_are_numbers(spark):
    rows = spark.createDataFrame([(1, "arbol", "ct-pl-193_v3.pdf"), (1, "rag", "CT-PL-193 v03.pdf"), (2, "arbol", "CT-PL-7_v10.pdf"), (2, "rag", "ct-pl-7 v2.pdf")], "qid int, agent string, source_file string")
    found = V.version_discrepancies(rows)
    assert [(r.qid, r.code, r.arbol, r.rag) for r in found.collect()] == [(2, "CT-PL-7", ["10"], ["2"])]
    assert V.version_notes(found).first().notes == ["El arbol de decision usa CT-PL-7 version 10 y los documentos recuperados citan CT-PL-7 version 2."]


def test_prompts_and_replies(spark):
    assert one(spark, X.question_prompt(F.lit("¿Fiebre?"), F.array(F.lit("Sí"), F.lit("No")), F.array(F.lit("caja")))) == "**¿Fiebre?**\n\ncaja\n\nResponde con una opción:\nSí / No\n\nSi no tienes el dato, responde «no sé»."
    assert one(spark, A.group_instruction(F.lit("externas"), F.lit("más"), {"externas": "solo eso"})) == "solo eso\nmás"
    replies = spark.createDataFrame([(1, '{"ids": ["u2", "u1", "u2"]}'), (2, "nope"), (3, '{"ids": "u1"}')], "qid int, reply string")
    assert [(r.qid, r.pos, r.uid) for r in A.picks(replies).collect()] == [(1, 1, "u2"), (1, 2, "u1"), (1, 3, "u2")]
    units = spark.createDataFrame([(1, "u1", "the dose of the drug"), (1, "u2", "la dosis de la droga")], "qid int, uid string, unit string")
    said = spark.createDataFrame([(1, '{"traducciones": {"u1": "u1: la dosis", "u2": "x", "u9": "y"}}'), (1, "{")], "qid int, reply string")
    assert [(r.uid, r.translation) for r in A.translations(said, units).collect()] == [("u1", "la dosis")]


# --- retrieval


def corpus(spark, n=240):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(3, 8))) for _ in range(150)]
    texts = [" ".join(draw.choice(words[: 1 + int(150 * draw.random() ** 2)]) for _ in range(draw.randrange(0, 60))) for _ in range(n)]
    rows = [(i, t, R.INSTITUTIONAL if i % 4 == 0 else "guia") for i, t in enumerate(texts)]
    asked = [(q, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 9)))) for q in range(25)]
    return spark.createDataFrame(rows, "chunk_id long, text string, source_type string"), spark.createDataFrame(asked, "qid long, question string")


def test_embedded_texts(spark):
    chunks, _ = corpus(spark, 40)
    rows = {r.chunk_id: r.text for r in chunks.collect()} | {900: None, 901: "the of", 902: "ñandú ÑANDÚ zz"}
    texts = spark.createDataFrame(list(rows.items()), "chunk_id long, text string")
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    toks = {i: one_ for i, one_ in ((r.chunk_id, r.t) for r in texts.select("chunk_id", X.tokens("text").alias("t")).collect())}
    bucket = lambda t: int(md5(t)[:4], 16)
    df = {}
    for ts in toks.values():
        for b in {bucket(t) for t in ts}:
            df[b] = df.get(b, 0) + 1
    got = {r.chunk_id: np.array(r.embedding) for r in embed.vectors(texts, embed.fit(texts, dimensions=160), dimensions=160).collect()}
    for i, ts in toks.items():
        want = np.zeros(160)
        for t in ts:
            b = bucket(t)
            idf = math.log((len(rows) + 1) / (df[b] + 1)) + 1
            bits = "".join(f"{int(md5(f'7:{k}:{b}')[8 * w : 8 * w + 8], 16):032b}"[::-1] for k in range(2) for w in range(4))
            want += [idf * (1 - 2 * int(x)) for x in bits[:160]]
        if want.any():
            want /= np.linalg.norm(want)
        assert np.allclose(got[i], want, atol=1e-9)
    assert not got[900].any() and not got[901].any() and np.isclose(np.linalg.norm(got[902]), 1)


def test_vector_index_recall(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(30, 16))
    x = centers[draw.integers(0, 30, 3000)] + 0.3 * draw.normal(size=(3000, 16))
    x[1000:2000] = x[0]  # a third of all rows are one vector
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, "guia" if i % 3 else R.INSTITUTIONAL, v.tolist()) for i, v in enumerate(x)] + [(9999, "guia", None)], "chunk_id long, source_type string, embedding array<float>")
    index = VectorIndex.build(rows, f"{tmp_path}/index", parts=8)
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = R.dense_search(rows.where("embedding IS NOT NULL"), asked, 10, digits=5)
    assert recall(index.search(asked, 10, digits=5), exact).first().recall >= 0.9
    assert index.rows.count() == 3000 and index.probes() < len(index.quantiser.centers)
    own = R.dense_search(rows.where("embedding IS NOT NULL"), asked, 5, R.INSTITUTIONAL, digits=5)
    monkeypatch.setattr(R, "QUESTIONS", 40)
    again = VectorIndex.load(spark, f"{tmp_path}/index")
    assert recall(again.search(asked, 5, R.INSTITUTIONAL, digits=5), own).first().recall >= 0.9
    # with all lists and enough candidates the search is exact
    every = again.search(asked, 5, R.INSTITUTIONAL, probes=len(index.quantiser.centers), refine=2000, digits=5)
    assert sorted((r.qid, r.chunk_id, r.rank) for r in every.collect()) == sorted((r.qid, r.chunk_id, r.rank) for r in own.collect())
    assert index.search(asked.limit(0), 10).count() == 0


def found(rows):
    return sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 6)) for r in rows.collect())


def test_stored_index(spark, tmp_path, monkeypatch):
    from lucerna.operators import stored_index

    monkeypatch.setattr(stored_index, "CELL", 16)
    chunks, asked = corpus(spark)
    index = StoredIndex.create(chunks, f"{tmp_path}/i", parts=4)
    want = lambda rows, *more: found(I.bm25_search(I.build_index(rows), asked, 5, *more, digits=6))
    got = index.search(asked, 5, digits=6)
    assert found(got.found) == want(chunks) and 0 < got.read < got.asked
    # one chunk in a hundred is replaced, one is new, two go; old files stay as they are
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    new = spark.createDataFrame([(7, "abc abc new words", "guia"), (100, "", "guia"), (9000, "abc only", R.INSTITUTIONAL)], "chunk_id long, text string, source_type string")
    index.upsert(new)
    index.delete(spark.createDataFrame([(3,), (4,), (77777,)], "chunk_id long"))
    now = chunks.where("chunk_id NOT IN (3, 4, 7, 100)").unionByName(new)
    assert {p: t for p, t in ((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "i").rglob("*.parquet")) if p in before} == before
    index = StoredIndex(spark, f"{tmp_path}/i")
    assert found(index.search(asked, 5, digits=6).found) == want(now)
    assert found(index.search(asked, 3, R.INSTITUTIONAL, 6).found) == found(I.bm25_search(I.build_index(now), asked, 3, R.INSTITUTIONAL, 6))
    index.upsert(chunks.where("chunk_id = 7"))
    index.merge()
    now = chunks.where("chunk_id NOT IN (3, 4, 100)").unionByName(new.where("chunk_id <> 7"))
    assert len(index._segments()) == 1 and found(index.search(asked, 5, digits=6).found) == want(now)
    assert index.rows().count() == now.count()


def test_header_rule_in_retrieval(spark):
    rows = [(1, "Proceso: x Código: CT-PL-193 neumonia tratada", "a", "institucional", "Dosis", 1, None), (2, "neumonia tratada con dosis", "a", "institucional", "Dosis", 2, None)] + [(k, f"otro texto {k}", "b", "guia", "s", 3, None) for k in range(3, 30)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, source_file string, source_type string, section string, page int, topic string").withColumn("chunk_index", F.col("chunk_id"))
    vectors = chunks.select("chunk_id", "source_type", F.array(F.lit(1.0)).alias("embedding"))
    asked = spark.createDataFrame([(1, "neumonia tratada", [1.0]), (2, "version del codigo neumonia", [1.0])], "qid long, question string, vector array<double>")
    got = {(r.qid, r.chunk_id): r.penalty for r in R.hybrid_retrieve(I.build_index(chunks), chunks, vectors, asked, floor=None).collect()}
    assert got[1, 1] == -W.ADMIN_PENALTY and got[2, 1] == 0 and got[1, 2] == 0


def test_a_refusal_keeps_its_sources(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, "alfa beta gamma delta" if k < 2 else f"otro{k} texto{k}", "a", "guia", "s", 2, None, k) for k in range(8)], "chunk_id long, text string, source_file string, source_type string, section string, page int, topic string, chunk_index int")
    vectors = chunks.select("chunk_id", "source_type", F.array(F.lit(1.0)).alias("embedding"))
    asked = spark.createDataFrame([(1, "alfa beta", [1.0])], "qid long, question string, vector array<double>")
    engine = Engine.build(chunks, vectors)
    monkeypatch.setattr(A, "extractive_answer", lambda found, asked, idf: asked.select("qid", F.lit(W.REFUSAL_TEXT).alias("answer")))
    monkeypatch.setattr(R, "uncovered", lambda rows, *a, **b: rows.select("qid"))
    row = engine.answer(asked).first()
    assert row.answer == W.REFUSAL_TEXT and row.refused is None and row.n_sources > 0


def test_nodes_by_protocol(spark):
    nodes = spark.createDataFrame([("P", "s", "start", "fiebre"), ("P", "a", "action", "fiebre alta en aeruginosa"), ("P", "b", "action", "cultivo de sangre"), ("P", "c", "action", "radiografia"), ("Q", "z", "action", "fiebre fiebre")], "protocol_id string, node_id string, kind string, text string")
    asked = spark.createDataFrame([(1, "P", "¿Pseudomonas y fiebre?"), (2, "Q", "cultivo"), (3, "P", "que manejo")], "qid long, protocol_id string, question string")
    assert [(r.qid, r.node_id) for r in I.rank_nodes(nodes, asked).collect()] == [(1, "a")]


# --- scans


def test_one_long_document(spark):
    """A document of all rows is split evenly, and gives what a window over it gives."""
    from pyspark.sql.window import Window

    # else so few rows are put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(40_000).select(F.lit("d").alias("source_file"), (F.col("id") % 400).cast("int").alias("page"), F.floor(F.col("id") / 400).cast("int").alias("pos"), F.when(F.col("id") % 997 == 5, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("title"))
    order = Window.partitionBy("source_file").orderBy("page", "pos")
    got = scan.numbers(scan.last_values(rows.repartition(4), ["source_file"], ["page", "pos"], {"last": F.col("title")}), ["source_file"], ["page", "pos"], "n")
    sizes = [r["count"] for r in got.groupBy(scan.PART).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * 10_000
    want = rows.withColumn("last", F.last("title", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order) - 1)
    columns = ["source_file", "page", "pos", "title", "last", "n"]
    assert got.select(*columns).exceptAll(want.select(*columns)).isEmpty() and got.count() == 40_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_title_paths_over_many_documents(spark):
    titles = ["Antes", "2. RECOMENDACIONES", "MANEJO", "Hemocultivos", "5. Diagnóstico: Orina", "Tarjetas de bolsillo", None, ""]
    draw = random.Random(8)
    rows = [(f"d{draw.randrange(3)}" if k % 3 else "big", k // 7, k % 7, draw.choice(titles)) for k in range(900)]
    got = {(r.source_file, r.page, r.pos): r.path for r in G.title_paths(spark.createDataFrame(rows, "source_file string, page int, pos int, title string").repartition(5)).collect()}
    top = mid = None
    last = None
    for f, page, pos, t in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if f != last:
            top = mid = None
            last = f
        want = t
        if t:
            head = t.partition(":")[0]
            if t.startswith("Tarj") or t[0].isdigit():
                top, mid = head, None
                want = " — ".join(x for x in (top, t.partition(": ")[2]) if x)
            elif t.isupper():
                mid = t
                want = " — ".join(x for x in (top, mid) if x)
            else:
                want = " — ".join(x for x in (top, mid, t) if x)
        assert got[f, page, pos] == want, (f, page, pos, t)


def test_quantiles(spark):
    draw = random.Random(2)
    for values in ([5.0], [1.0, 2.0], [draw.gauss(0, 1) for _ in range(40_001)], [3.5] * 30_000 + [draw.random() * 1e12 for _ in range(10_000)], [-1e308, 1e308, 0.0, 5e-324], [float(k % 3) for k in range(50_000)]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for share in (0.0, 0.5, 0.9, 1.0):
            assert scan.quantile(rows, "v", share) == pytest.approx(float(np.quantile(values, share)), rel=1e-12)
    assert scan.quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None
    assert E.latency(spark.createDataFrame([(1.0,), (4.0,)], "v double"), "v").first() == (2, 2.5, 2.5)


def test_term_counts_need_no_shuffle(spark, tmp_path):
    rows = [(1, "red blue red red", "a"), (2, None, "a"), (3, "", "b"), (4, "blue", None), (5, " ".join(f"w{k % 97}" for k in range(1000)), "b")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, source_type string")
    counted = StoredIndex(spark, str(tmp_path), 2)._counted(chunks)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    got = {r.chunk_id: (r.len, {t.term: t.tf for t in r.terms}) for r in counted.collect()}
    assert got[1] == (4, {"blue": 1, "red": 3}) and got[2] == got[3] == (0, {}) and got[4] == (1, {"blue": 1})
    assert got[5] == (1000, {f"w{k}": 11 if k < 1000 % 97 else 10 for k in range(97)})


def test_rules_on_parts_are_dealt_out(spark, tmp_path):
    part = spark.createDataFrame([(k, f"name {k % 7}", "TYPE") for k in range(400)], "p_partkey long, p_name string, p_type string")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("external_units", "sub_questions"):
        per_task = catalog.QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count()
        assert per_task.count() >= 4 and per_task.agg(F.max("count")).first()[0] <= 110


# --- graphs


def graph(spark, pairs, decisions=()):
    edges = spark.createDataFrame([("P", k, a, b, f"l{k}", False, False) for k, (a, b) in enumerate(pairs)], S.EDGES)
    names = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([("P", n, N.DECISION if n in decisions else "action", n, "", "") for n in names], S.NODES)
    return nodes, edges


def test_conditions_of_random_graphs_with_cycles(spark):
    draw = random.Random(6)
    for _ in range(4):
        names = [f"n{k}" for k in range(90)]
        pairs = [(draw.choice(names), draw.choice(names)) for _ in range(170)]
        decisions = set(names[::2])
        nodes, edges = graph(spark, [("n0", "n1"), *pairs], decisions)
        out = {}
        for a, b in [("n0", "n1"), *pairs]:
            out.setdefault(a, []).append(b)

        def reach(n):
            seen, todo = {n}, [n]
            while todo:
                for m in out.get(todo.pop(), ()):
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            return seen

        can = {n: reach(n) for n in names}
        start = spark.createDataFrame([("P", "n0")], "protocol_id string, node_id string")
        routes = {r.node_id: r.path for r in N.routes(edges, start).collect()}
        want = {(n, pos, s.node_id, s.label) for n, path in routes.items() for pos, s in enumerate(path) if s.node_id in decisions and not all(n in can[o] for o in set(out[s.node_id]))}
        assert {tuple(r) for r in N.all_conditions(edges, nodes, start).select("node_id", "pos", "decision_id", "label").collect()} == want
        marks = spark.createDataFrame([("P", n, k) for k, n in enumerate(names)], "protocol_id string, node_id string, slot long")
        held = {}
        for r in N.reached_by(edges, marks).collect():
            held.setdefault(r.node_id, set()).update(64 * r.word + b for b in range(64) if r.bits >> b & 1)
        assert all(held.get(n, set()) == {k for k, m in enumerate(names) if n in can[m]} for n in names)


def test_deep_chain_and_many_marks(spark, monkeypatch):
    monkeypatch.setattr(N, "WORDS", 4)
    pairs = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(1000)]
    _, edges = graph(spark, pairs)
    began = time.time()
    start = spark.createDataFrame([("P", "n0000")], "protocol_id string, node_id string")
    assert N.routes(edges, start).agg(F.max("depth"), F.count("*")).first() == (1000, 1001)
    marks = spark.createDataFrame([("P", f"n{k:04d}", k) for k in range(1000)], "protocol_id string, node_id string, slot long")
    reach = N.reached_by(edges, marks).groupBy("node_id").agg(F.sum(F.bit_count("bits")).alias("n"))
    assert {r.node_id: r.n for r in reach.collect()} == {f"n{k:04d}": min(k + 1, 1000) for k in range(1001)}
    # rows are words, not marks
    assert N.reached_by(edges, marks).count() <= 1001 * 16
    assert time.time() - began < 120


def test_large_graphs_are_in_no_task(spark, monkeypatch):
    draw = random.Random(9)
    pairs = [("n0", "n1"), *((f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(130)), ("n1", "m0"), *((f"m{k}", f"m{k + 1}") for k in range(6)), ("m6", "n0")]
    nodes, edges = graph(spark, pairs, {f"n{k}" for k in range(0, 60, 2)})
    edges = edges.withColumn("edge_pos", F.col("edge_pos") % 3)
    start = spark.createDataFrame([("P", "n0"), ("P", "n7")], "protocol_id string, node_id string")
    marks = spark.createDataFrame([("P", f"n{k}", k) for k in range(60)] + [("P", "m3", 200)], "protocol_id string, node_id string, slot long")
    results = lambda: [sorted(map(str, df.collect())) for df in (N.routes(edges, start), N.reached_by(edges, marks), N.all_conditions(edges, nodes, start.limit(1)), N.join_nodes(edges, start), N.first_section(N.routes(edges, start.limit(1)), nodes))]
    want = results()
    monkeypatch.setattr(N, "EDGES", 20)
    monkeypatch.setattr(N, "ROUNDS", 3)
    monkeypatch.setattr(N, "LEVELS", 4)

    def held(rows, ways):
        raise AssertionError("a task holds the whole graph")

    monkeypatch.setattr(N, "_followed", held)
    monkeypatch.setattr(N, "_marked", held)
    assert results() == want


def test_meeting_points_and_starts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "STARTS", 2)
    _, edges = graph(spark, [("a", "c"), ("b", "d"), ("c", "e"), ("d", "e"), ("e", "f"), ("g", "g")])
    starts = lambda *names: spark.createDataFrame([("P", n) for n in names], "protocol_id string, node_id string")
    assert [r.node_id for r in N.join_nodes(edges, starts("a", "b")).collect()] == ["e"]
    assert N.join_nodes(edges, starts("a", "g")).count() == 0
    got = {r.start: r.n for r in N.routes(edges, starts(*"abcdefg")).groupBy("start").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 4, "b": 4, "c": 3, "d": 3, "e": 2, "f": 1, "g": 1}


def test_many_cases_in_parts_and_unknown_protocols(spark, monkeypatch):
    monkeypatch.setattr(N, "CASES", 10)
    _, nodes, edges = S.tree_tables(spark, [catalog.TREE])
    cases = spark.range(60).select(F.col("id").alias("case_id"), F.lit("XX-PL-001").alias("protocol_id"), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("n1"), F.lit("no"))).alias("answers"))
    assert {(r.status, r["count"]) for r in N.walk_cases(cases, nodes, edges).groupBy("status").count().collect()} == {(N.COMPLETE, 30), (N.PENDING, 30)}
    with pytest.raises(Exception, match="one start"):
        N.walk_cases(cases.withColumn("protocol_id", F.lit("ZZ")), nodes, edges).collect()


# --- readers


def test_pages_reader(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("uno\f \n\ftres")
    (tmp_path / "in" / "b.md").write_text("solo")
    pages = [{"text": "x", "metadata": {"page": 7}}, {"text": " "}, {"text": "y", "metadata": {"page_number": "z"}}]
    (tmp_path / "in" / "sub" / "c.json").write_text(json.dumps(pages))
    readers.register(spark)
    df = spark.read.format("document_pages").option("path", f"{tmp_path}/in").load()
    assert df.schema.simpleString() == "struct<source_file:string,page:int,text:string>"
    assert sorted(map(tuple, df.collect())) == [("a.txt", 1, "uno"), ("a.txt", 3, "tres"), ("b.md", 1, "solo"), ("c.json", 3, "y"), ("c.json", 7, "x")]
    # files that the filter rules out are not opened
    (tmp_path / "in" / "broken.json").write_text("{")
    assert [r.page for r in df.where("source_file = 'a.txt'").collect()] == [1, 3]
    assert df.where("source_file IN ('a.txt', 'b.md') AND page = 1").count() == 2
    assert df.where("NOT startswith(source_file, 'broken') AND NOT source_file = 'c.json'").count() == 3
    assert df.where("startswith(source_file, 'a')").count() == 2
    for path in (f"{tmp_path}/in", f"file:{tmp_path}/in", f"file://{tmp_path}/in"):
        assert spark.read.format("document_pages").option("path", path).option("names", "*.md").load().count() == 1
    with pytest.raises(Exception):
        spark.read.format("document_pages").option("path", f"{tmp_path}/in").load().collect()


def test_trees_reader(spark, tmp_path):
    def put(folder, version, name, content):
        (tmp_path / folder / version).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / version / name).write_text(content)

    put("XX-PL-001", "v02", "tree.json", json.dumps(catalog.TREE | {"metadata": catalog.TREE["metadata"] | {"version": 2}}))
    put("XX-PL-001", "v03", "tree.yaml", json.dumps(catalog.TREE))
    put("XX-PL-001", "v10", "notes.txt", "no tree here")
    diagram = {"document": {"code": "YY-PL-002", "version": "9", "title": "Otro", "scope": "d"}, "diagram": {"nodes": [{"id": "a", "kind": "Start", "text": "x"}, {"id": "b", "kind": "action", "text": "y"}], "edges": [{"from": "a", "to": "b"}]}}
    put("YY-PL-002", "1", "tree.yml", json.dumps(diagram))
    readers.register(spark)
    read = lambda table: spark.read.format("decision_trees").option("path", str(tmp_path)).option("table", table).load()
    assert sorted((r.protocol_id, r.version) for r in read("protocols").collect()) == [("XX-PL-001", "v03"), ("YY-PL-002", "v09")]
    assert read("nodes").count() == 9 and read("edges").where("protocol_id = 'YY-PL-002'").count() == 1
    assert N.problems(read("nodes"), read("edges")).count() == 0
    put("ZZ-PL-003", "v1", "tree.json", json.dumps(diagram))
    assert read("nodes").where("protocol_id = 'XX-PL-001'").count() == 7
    with pytest.raises(Exception, match="not of ZZ-PL-003"):
        read("nodes").collect()
    with pytest.raises(Exception, match="none of"):
        read("others").collect()


# --- streams


def test_threads_leave_the_store(spark, tmp_path):
    from lucerna.streaming.session import EXPIRED, conversations, state_store

    state_store(spark)
    # a run until no input is left would go on for ever, waiting for timers
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    _, nodes, edges = S.parse_tree(catalog.TREE)
    schema = "thread_id string, turn int, reply string"

    def run(rows, wait_ms):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
        stream = conversations(spark.readStream.schema(schema).parquet(f"{tmp_path}/turns"), nodes, edges, wait_ms)
        out = []
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        q.awaitTermination()
        held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
        return {(r.thread_id, r.status): r for r in out}, held[-1]

    got, open_ = run([(t, 0, None) for t in "tuv"], 10**9)
    assert {s for _, s in got} == {N.PENDING} and open_ >= 3
    got, fewer = run([("t", 1, "si"), ("u", 1, "no")], 10**9)
    assert got["u", N.COMPLETE].asked == 1 and got["t", N.PENDING].node_id == "n3" and fewer < open_
    got, _ = run([("t", 2, "bajo"), ("w", 0, None)], 1)
    assert json.loads(got["t", N.COMPLETE].answers) == {"n1": "si", "n3": "bajo"}
    time.sleep(0.1)
    got, _ = run([("x", 0, None)], 1)
    assert ("w", EXPIRED) in got and ("v", EXPIRED) not in got
    got, _ = run([("w", 1, None)], 10**9)
    assert got["w", N.PENDING].node_id == "n1" and got["w", N.PENDING].asked == 1


# --- agents


def test_a_branch_fails_alone(spark):
    rows = spark.range(40).select(F.col("id").alias("qid"))
    fails = lambda part: part.select("qid", F.when(F.col("qid").isin(7, 31), F.raise_error(F.lit("boom")).cast("string")).otherwise("ok").alias("said"), F.lit(None).cast("string").alias("error"))
    got = {r.qid: (r.said, r.error) for r in P.isolated(fails, rows, "qid long, said string, error string").collect()}
    assert len(got) == 40 and {q for q, (s, _) in got.items() if s is None} == {7, 31} and got[7][1].startswith("error_tecnico")

    def broken(part):
        raise KeyError("no such table")

    assert {r.error for r in P.isolated(broken, rows, "qid long, said string, error string").collect()} == {"error_tecnico: KeyError"}


def test_agents_without_models(spark):
    heads, nodes, edges = S.tree_tables(spark, [catalog.TREE])
    trees = P.Trees(heads.withColumns({"source_file": F.lit("XX-PL-001_v3.pdf"), "terms": F.array(F.lit("fever"))}), nodes, edges)
    asked = spark.createDataFrame([(1, "what to do with fever"), (2, "something else")], "qid long, question string")

    def retrieve(questions):
        return questions.where("qid = 1").select("qid", F.lit(1).alias("rank"), F.lit(5).alias("chunk_id"), F.lit("XX-PL-001_v4.pdf").alias("source_file"), F.lit("guia").alias("source_type"), F.lit("S").alias("section"), F.lit(2).alias("page"), F.lit("Give water.").alias("text"))

    got = {r.qid: r for r in P.agents(asked, trees, retrieve).collect()}
    assert got[1].n_blocks == 2 and "Give water." in got[1].text and got[1].text.endswith("El arbol de decision usa XX-PL-001 version 3 y los documentos recuperados citan XX-PL-001 version 4.")
    assert got[2].n_blocks == 0 and got[2].text == W.REFUSAL_TEXT and got[2].tree_status == "sin_protocolo" and got[2].rag_status == "abstencion"

    def lost(questions):
        raise OSError("index gone")

    got = {r.qid: r for r in P.agents(asked, trees, lost).collect()}
    assert got[1].n_blocks == 1 and got[1].rag_error == "error_tecnico: OSError" and got[1].tree_verification == V.VERIFIED


def test_vector_index_recall_of_even_vectors(spark, tmp_path):
    """Vectors without groups: as many lists are looked into as their neighbours lie in."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, "guia", v.tolist()) for i, v in enumerate(x)], "chunk_id long, source_type string, embedding array<float>")
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    index = VectorIndex.build(rows, f"file://{tmp_path}/even")
    assert recall(index.search(asked, 10), R.dense_search(rows, asked, 10)).first().recall >= 0.9


def test_nodes_of_one_text_are_ranked_once(spark, monkeypatch):
    """Equal texts and equal questions make one pair; each node and question still has its own rows, equal scores by id."""
    kinds = ["fever grade", "fever ward", "home rest water"]
    nodes = spark.createDataFrame([("P", f"{k:02d}", "action", kinds[k % 3]) for k in range(30)] + [("Q", "00", "action", "fever ward")], "protocol_id string, node_id string, kind string, text string")
    asked = spark.createDataFrame([(i, "P", "home water" if i % 2 else "grade of fever") for i in range(12)], "qid long, protocol_id string, question string")
    pairs, top_k = [], I.top_k
    monkeypatch.setattr(I, "top_k", lambda scored, *options: pairs.append(scored.count()) or top_k(scored, *options))
    got = sorted((r.qid, r["rank"], r.node_id) for r in I.rank_nodes(nodes, asked).collect())
    want = {0: ["00", "03", "06", "09"], 1: ["02", "05", "08", "11"]}
    assert got == [(i, r + 1, n) for i in range(12) for r, n in enumerate(want[i % 2])]
    assert pairs[0] <= 2 * 3


def test_embedder_looks_at_each_text_once(spark, monkeypatch):
    """The model and the vectors of the corpus come from one look at its texts."""
    from lucerna import catalog_plans

    folder, seen, made = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), embed.buckets

    @F.udf("string")
    def looked(text):
        seen.add(1)
        return text

    monkeypatch.setattr(embed, "buckets", lambda c: made(looked(c)))
    assert catalog_plans.embedded_texts(spark, folder).count() > 0
    texts = sum(spark.read.parquet(f"{folder}/{name}.parquet").count() for name in ("documents", "benchmark"))
    assert seen.value == texts
