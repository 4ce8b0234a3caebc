"""The engine's own operators: hand-derived values, and properties of the sequential ones."""

import json

import pytest
from pyspark.sql import functions as F

from lucerna import catalog
from lucerna.functions import text as X
from lucerna.functions import words as W
from lucerna.operators import answer as A
from lucerna.operators import flow as N
from lucerna.operators import index as I
from lucerna.operators import ingest as G
from lucerna.operators import retrieve as R
from lucerna.operators import segment
from lucerna.operators import verify as V
from lucerna.sources import files as S


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_tokens_and_queries(spark):
    assert one(spark, X.tokens("s"), s="No usar la Técnica NI el método") == ["no", "usar", "tecnica", "ni", "metodo"]
    assert one(spark, X.retrieval_query("s"), s="¿Dosis de amoxicilina? ¿Que guia?") == "¿Dosis de amoxicilina?"
    assert [one(spark, X.approx_tokens("s"), s=s) for s in ("", "a b c", " ".join("x" * 30))] == [1, 4, 40]
    assert one(spark, X.qualifier("s"), s="alto + device") == "device"
    assert one(spark, X.version_label("s"), s="ver 3") == "v03"
    assert one(spark, X.fold("s"), s="ﬁÁ²ǎŐ…각½") == "fia2ao...\u1100\u1161\u11a81⁄2"
    assert one(spark, X.citations("s"), s="x [Guia: doc1 , p. 1] y [Guia: b, s]") == ["doc1", "b"]


def test_refusals(spark):
    assert one(spark, X.is_refusal("s"), s="No encuentro eso.")
    assert not one(spark, X.is_refusal("s"), s="palabra " * 70 + "no encuentro eso")


def test_choices():
    options = ["Sí", "No", "alto riesgo", "bajo riesgo"]
    said = {"2": "No", "SI": "Sí", "no sé": X.UNKNOWN, "no se ha medido": "No", "alto": None, "es de alto riesgo": "alto riesgo", "": None, "otra": None, "¿?": None, "desconocido": X.UNKNOWN}
    assert {s: X.choose(s, options) for s in said} == said
    pair = ["Sí — gestante", "No"]
    assert [X.choose(s, pair) for s in ("yes", "negativo", "gestante", "es paciente gestante y si", "si")] == [pair[0], "No", None, pair[0], pair[0]]


def chunks(spark, texts):
    return spark.createDataFrame([(i, t, "guia") for i, t in enumerate(texts, 1)], "chunk_id long, text string, source_type string")


def scores(spark, q):
    index = I.build_index(chunks(spark, ["aa bb", "aa cc cc", "aa"]))
    return {r.chunk_id: round(r.score, 6) for r in I.bm25_scores(index, spark.createDataFrame([(1, q)], "qid long, question string")).collect()}


def test_bm25_values(spark):
    assert scores(spark, "cc") == {2: 0.628708}
    assert scores(spark, "cc cc") == {2: 1.257417}
    assert scores(spark, "aa") == {1: -0.077022, 2: -0.062875, 3: -0.099383}
    index = I.build_index(chunks(spark, ["aa bb", "aa cc cc", "aa"]))
    assert I.bm25_search(index, spark.createDataFrame([(1, "aa")], "qid long, question string"), 3).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 9, 1), (1, 7, 2)], "qid long, chunk_id long, rank int")
    got = [(r.chunk_id, round(r.score, 6)) for r in R.fuse([a, b]).orderBy("rank").collect()]
    assert got == [(7, 0.032522), (9, 0.016393), (8, 0.016129)]


def test_quota(spark):
    rows = [(1, i, s, t, f) for i, (s, t, f) in enumerate([(0.9, "guia", "a"), (0.8, "guia", "a"), (0.7, "guia", "a"), (0.6, "guia", "b"), (0.3, "institucional", "p"), (0.2, "institucional", "p"), (0.01, "institucional", "p")])]
    df = spark.createDataFrame(rows, "qid long, chunk_id long, score double, source_type string, source_file string")
    got = [r.chunk_id for r in R.select_with_quota(df, 4, 3, 0.05, None, 2).orderBy("rank").collect()]
    assert got == [0, 1, 4, 5]
    assert [r.chunk_id for r in R.select_with_quota(df, 1, 2, 0.05).orderBy("rank").collect()] == [4, 5]


def test_rare_limit():
    assert (R.rare_limit(850), R.rare_limit(100)) == (8, 3)


def sections(spark, s, **options):
    return [(r["title"], r["body"]) for r in one(spark, segment.sections("s", **options), s=s)]


def units(spark, s, section=""):
    return one(spark, segment.units("s", F.lit(section)), s=s)


def test_sections(spark):
    assert sections(spark, "plain") == [(W.DEFAULT_SECTION, "plain")]
    assert sections(spark, "") == [] and sections(spark, "", keep_empty=True) == [(W.DEFAULT_SECTION, "")]
    got = sections(spark, "before\n# First\none\n**Dose:** two\n# " + "long " * 30 + "\nrest")
    assert [t for t, _ in got] == [W.DEFAULT_SECTION, "First", "Dose", W.DEFAULT_SECTION] and got[-1][1].endswith("rest")
    assert sections(spark, "# A\n\n# B\nx") == [("B", "x")] and sections(spark, "# A\n\n# B\nx", keep_empty=True) == [("A", ""), ("B", "x")]
    assert sections(spark, "**12.** Smith J\n**13. En adultos** hola\n**Tabla 2. Dosis**\nfila\n**Figura 1:** no") == [(W.DEFAULT_SECTION, "**12.** Smith J"), ("13. En adultos", "hola"), ("Tabla 2. Dosis", "fila\n**Figura 1:** no")]
    long = "En pacientes adultos " + "muy " * 40
    assert sections(spark, f"# Manejo inicial: {long}\nx")[0][0] == "Manejo inicial"
    assert sections(spark, f"# 3. {long}¿que hacer?\nx")[0][0].endswith("…")


def test_units(spark):
    assert units(spark, "Opciones de manejo:\n- Primera opcion larga\n- Segunda opcion\n- que sigue") == ["Opciones de manejo: Primera opcion larga; Segunda opcion que sigue."]
    assert units(spark, "La primera frase tiene palabras.\n\nEsta frase depende de la anterior.") == ["La primera frase tiene palabras. Esta frase depende de la anterior."]
    assert len(units(spark, "Lista:\n" + "\n".join(f"- Punto {i} " + "palabra " * 15 for i in range(6)))) == 6
    assert units(spark, "Manejo\n\n- Uno dos tres\n- Cuatro cinco\n- seis", "A — Manejo") == ["Manejo: Uno dos tres; Cuatro cinco seis."]
    assert units(spark, "Una linea de texto.\n- dos tres cuatro\notra linea aqui abajo", "S") == ["Una linea de texto.", "S: dos tres cuatro.", "otra linea aqui abajo"]
    assert units(spark, "Hallazgo con nota †Primera nota al pie ‡Segunda nota al pie.") == ["†Primera nota al pie", "‡Segunda nota al pie."]
    assert units(spark, "Box 2. Main Indications to Treat\n\nFrases de entrada al final:") == ["Frases de entrada al final:"]
    row = "T — 1.\nCol: a\nDos: b\nTres: c\nNotas de la tabla:\n- (1) nota."
    assert units(spark, row, "T — 1") == ["T — 1. Col: a. Dos: b. Tres: c. Notas: (1) nota."]
    assert units(spark, "", "S") == []


def test_outside_units(spark):
    value = lambda f, s: one(spark, f("s"), s=s)
    assert value(X.tidy_external, "adults 1 52 53; causa SAMR_157 y _P. aeruginosa_ 132 , MRSA.8 fin †") == "adults; causa SAMR y P. aeruginosa, MRSA. fin"
    assert value(X.strip_references, "Se recomienda tratar cinco dias. Nicolle LE, Gupta K, et al. Guia. doi:10") == "Se recomienda tratar cinco dias."
    assert value(X.strip_references, "Additional readings: Smith J et al. Guia 2020") == "" and value(X.strip_references, "Sin citas LE, nada") == "Sin citas LE, nada"
    bad = ["ATS=a, FiO2=b, IDSA=c.", "Adapted from the 2025 guideline.", "MRSA=meticillin resistant.", "continua de otra frase.", "We suggest treating with the", "No single sign has good"]
    assert [value(X.unusable_external, s) for s in bad] == [True] * len(bad)
    assert not value(X.unusable_external, "Frailty or poor social support") and not value(X.unusable_external, "Se recomienda tratar cinco dias.")
    assert value(X.is_study_summary, "El estudio de Prina introdujo algo.") and value(X.trim_tail, "Frase completa aqui. Luego sigue como") == "Frase completa aqui."
    assert value(X.file_key, "Guia#U00e9s_2.pdf") == "guiaes2pdf"


def packed_by_loop(parts, budget, ratio):
    size = lambda p: max(1, int(len(p.split()) / 0.75))
    out, a = [], 0
    for b in range(len(parts) + 1):
        if b == len(parts) or (b > a and sum(map(size, parts[a : b + 1])) > budget):
            out.append("\n\n".join(parts[a:b]))
            a = next(j for j in range(a, b + 1) if sum(map(size, parts[j:b])) <= int(budget * ratio))
    return out


def test_packing(spark):
    parts = [(f"p{i} " + "w " * (i * 7 % 40)).strip() for i in range(30)]
    for budget, ratio in ((60, 0.3), (20, 0.9), (400, 0.15)):
        assert one(spark, segment.packed("s", budget, ratio), s="\n\n".join(parts)) == packed_by_loop(parts, budget, ratio)
    assert one(spark, segment.packed("s", 10, 0.1, 50), s="x") == ["x"] and one(spark, segment.packed("s"), s="") == [""]


def test_title_paths(spark):
    titles = ["Antes", "2. RECOMENDACIONES", "MANEJO INICIAL", "Hemocultivos", "5. Diagnóstico: Análisis de orina", "Cultivo", "Tarjetas de bolsillo", "Dosis"]
    rows = spark.createDataFrame([("f", 1, k, t) for k, t in enumerate(titles)], "source_file string, page int, pos int, title string")
    want = ["Antes", "2. RECOMENDACIONES", "2. RECOMENDACIONES — MANEJO INICIAL", "2. RECOMENDACIONES — MANEJO INICIAL — Hemocultivos", "5. Diagnóstico — Análisis de orina", "5. Diagnóstico — Cultivo", "Tarjetas de bolsillo", "Tarjetas de bolsillo — Dosis"]
    assert [r.path for r in G.title_paths(rows).orderBy("pos").collect()] == want


def test_admin_sections(spark):
    def penalty(section, question, source="institucional", page=2, body=""):
        return one(spark, R.admin_penalty(F.lit(section), F.lit(question), F.lit(source), F.lit(page), F.lit(body)))

    assert penalty("4. INTRODUCCIÓN", "dosis") == -0.2 and penalty("4. INTRODUCCIÓN — Manifestaciones", "dosis") == 0
    assert penalty("3. Criterio de clasificación", "¿como se clasifican?") == 0 and penalty("CONTROL DE CAMBIOS — 06", "dosis") == -0.2
    assert penalty("x", "dosis", "guia", 1) == -0.2 and penalty("x", "dosis", "institucional", 1) == 0
    header = "Proceso: Cuidado Código: CT-PL-193"
    assert penalty("x", "dosis", body=header) == -0.2 and penalty("Objetivo", "¿que versión es?", body=header) == 0


def test_chunking(spark):
    body = ["".join(f"palabra{chr(97 + p)} " for _ in range(40)) for p in range(7)]
    pages = [(f"d{k}", p, f"Revista {p} de 9\n{'# 1. Objetivo' if p == 1 else ''}\n{body[p]}\ncontacto@x.org") for k in range(2) for p in range(1, 7)]
    got = G.chunk_pages(spark.createDataFrame(pages, "source_file string, page int, text string")).collect()
    assert len(got) == 12 and all("Revista" not in r.text and "@" not in r.text for r in got)
    assert {r.section for r in got} == {"1. Objetivo"} and {r.chunk_index for r in got} == set(range(6))


def test_continuations(spark):
    rows = [(1, 1, "f", "s", 4, "b", 0.5), (1, 2, "f", "s", 9, "z", 0.4), (1, 3, "f", "s", 3, "a", 0.7)]
    df = spark.createDataFrame(rows, "qid long, rank int, source_file string, section string, chunk_index int, text string, score double")
    assert [(r.rank, r.text, r.score) for r in A.merge_continuations(df).orderBy("rank").collect()] == [(1, "a\n\nb", 0.7), (2, "z", 0.4)]


def test_select_units_shares(spark):
    rows = [(1, f"u{i}", "institucional" if i < 5 else "guia", float(9 - i), i, 0) for i in range(9)]
    df = spark.createDataFrame(rows, "qid long, uid string, source_type string, fit double, rank int, ord int")
    picked = A.select_units(df, 6).collect()
    assert sum(r.source_type == "institucional" for r in picked) == 3 and len(picked) == 6
    assert A.select_units(df.where("source_type = 'institucional'"), 6).count() == 5


def test_grounding(spark):
    p = one(spark, V.grounding_problems(F.col("s"), F.array(F.lit("doc1.pdf")), F.lit(None).cast("array<string>")), s="[Guia: doc1, s] y [Guia: otro, s]; probablemente; otras guias dicen")
    assert len(p) == 3
    assert one(spark, V.grounding_problems(F.col("s"), F.array(F.lit("doc1.pdf")), F.lit(None).cast("array<string>")), s="[Guia: doc1, s]; no hay otras guias") == []
    assert one(spark, V.evaluated(F.lit("x"), F.array().cast("array<string>"), F.lit(None).cast("boolean"))) == V.UNVERIFIABLE
    assert one(spark, V.admitted(F.lit(None).cast("boolean")))


DIAGRAM = {
    "document": {"code": "YY-PL-002", "version": "9", "title": "Otro", "scope": "demo"},
    "diagram": {
        "sections": {1: "Entrada", 2: "Manejo"},
        "nodes": [{"id": i, "kind": k, "text": s, "section": x} for i, k, s, x in (("a", "Start", "Inicio", 1), ("b", "decision", "¿Fiebre?\n• alta", 1), ("c", "action", "Medir ITU baja", 1), ("d", "action", "Cultivo", 2), ("e", "decision", "¿Riesgo?", 2), ("f", "action", "Sala", 2), ("g", "action", "Casa", 2), ("h", "criteria", "Criterios", 2), ("i", "action", "Fin", 2))],
        "edges": [{"from": a, "to": b, "label": c, **more} for a, b, c, more in (("a", "c", "", {"independent": True}), ("a", "d", "", {"independent": True}), ("c", "b", "", {}), ("d", "b", "", {}), ("b", "e", "Sí", {}), ("b", "i", "No", {}), ("e", "f", "Sí + ITU baja", {}), ("e", "g", "No", {}), ("e", "g", "Quizá + cistitis", {}), ("h", "e", "", {"reference": True}), ("e", "h", "Contexto", {}), ("f", "i", "si recurrencia", {}), ("g", "i", "", {}))],
    },
}


def test_both_dialects():
    head, nodes, edges = S.parse_tree(DIAGRAM)
    assert head == {"protocol_id": "YY-PL-002", "version": "v09", "name": "Otro", "description": "demo"}
    assert nodes[0]["kind"] == "start" and nodes[1]["section"] == "Entrada" and [e["independent"] for e in edges[:3]] == [True, True, False]
    head, nodes, _ = S.parse_tree(catalog.TREE)
    assert head["protocol_id"] == "XX-PL-001" and nodes[1]["source_ref"] == "p.1" and nodes[1]["section"] == ""
    for wrong in ({}, {"nodes": [], "edges": []}, catalog.TREE | {"metadata": {}}, catalog.TREE | {"edges": catalog.TREE["edges"][1:] + [{"from": "n0", "to": "zz"}]}, catalog.TREE | {"edges": [e for e in catalog.TREE["edges"] if e["label"] != "no"]}):
        with pytest.raises(ValueError):
            S.parse_tree(wrong)


def test_walks():
    _, nodes, edges = S.parse_tree(catalog.TREE)
    got = N.walk(nodes, edges, {})
    assert (got["status"], got["stopped_at"], got["options"], [s["node_id"] for s in got["steps"]]) == (N.PENDING, "n1", ["si", "no"], ["n0"])
    got = N.walk(nodes, edges, {"n1": X.UNKNOWN})
    assert (got["status"], got["options"], [s["node_id"] for s in got["steps"]]) == (N.UNKNOWN_DATUM, ["si", "no"], ["n0"])
    assert N.walk(nodes, edges, {"n1": "no"})["status"] == N.COMPLETE
    routes = N.all_routes(nodes, edges)
    assert {r["status"] for r in routes} == {N.COMPLETE} and len(routes) == 3


def test_walk_of_independent_branches_and_qualifiers():
    _, nodes, edges = S.parse_tree(DIAGRAM)
    got = N.walk(nodes, edges, {"b": "Sí", "e": "Sí + ITU baja"})
    assert [(s["node_id"], s["choice"]) for s in got["steps"]] == [("a", None), ("c", None), ("d", None), ("b", "Sí"), ("e", "Sí + ITU baja"), ("f", None)]
    assert got["status"] == N.COMPLETE and got["notes"] == [{"label": "si recurrencia", "node_id": "i"}]
    got = N.walk(nodes, edges, {"b": "Sí"})
    assert got["options"] == ["Sí + ITU baja", "No"] and got["stopped_at"] == "e"
    only = [e | {"label": e["label"] and e["label"] + " + nunca"} if e["source"] == "e" else e for e in edges if e["label"] != "No"]
    got = N.walk(nodes, only, {"b": "Sí"})
    assert (got["status"], got["stopped_at"], got["options"], [s["node_id"] for s in got["steps"]]) == (N.NO_ROUTE, "e", [], list("acd") + ["b"])


def test_graph_problems(spark):
    _, nodes, edges = S.tree_tables(spark, [catalog.TREE, DIAGRAM])
    assert N.problems(nodes, edges).count() == 0
    assert {r.problem.split(":")[0] for r in N.problems(nodes.where("node_id <> 'n6'"), edges.where("edge_pos <> 5")).collect()} == {"unknown node", "dead decision"}


def test_routes_of_any_depth(spark):
    edges = spark.createDataFrame([("P", i, f"n{i}", f"n{(i + 1) % 130}", "", False, False) for i in range(130)], S.EDGES)
    starts = spark.createDataFrame([("P", "n0")], "protocol_id string, node_id string")
    assert N.routes(edges, starts).agg(F.max("depth"), F.count("*")).first() == (129, 130)


def test_render(spark):
    heads, nodes, edges = S.tree_tables(spark, [catalog.TREE, DIAGRAM])
    cases = spark.createDataFrame([(1, "XX-PL-001", {"n1": "no"}), (2, "YY-PL-002", {"b": "Sí", "e": "Sí + ITU baja"}), (3, "XX-PL-001", None)], "case_id long, protocol_id string, answers map<string,string>")
    walks = N.walk_cases(cases, nodes, edges)
    rows = {r.case_id: r for r in N.render(walks, nodes, heads).collect()}
    assert rows[1].answer_text == "Recorrido del árbol clínico XX-PL-001 v03:\n\n- Fever? → **no**\n- End" and rows[1].rule_id == "n6" and [c.section for c in rows[1].citations] == ["protocolo p.1"]
    assert rows[2].answer_text.endswith("- ¿Fiebre? → **Sí**\n- ¿Riesgo? → **Sí + ITU baja**\n- Sala\n\nAdemás, según el diagrama:\n- si recurrencia: Fin")
    assert [(c.section, c.verbatim_text) for c in rows[2].citations] == [("Entrada", "Medir ITU baja\n¿Fiebre?\n• alta"), ("Manejo", "Cultivo\n¿Riesgo?\nSala\nFin")]
    starts = nodes.where("kind = 'start'").select("protocol_id", "node_id")
    chosen = spark.createDataFrame([(7, "YY-PL-002", "g", 1)], "qid long, protocol_id string, node_id string, pos int")
    text = N.render_consult(chosen, nodes, edges, starts, heads).first().answer_text
    assert text == "Ramas del árbol clínico YY-PL-002 v09 relacionadas con la consulta:\n\n- Cuando «¿Fiebre?» = Sí y «¿Riesgo?» = No: Casa\n\n- Cuando «¿Fiebre?» = Sí y «¿Riesgo?» = Sí + ITU baja: Sala"
    over = {r.protocol_id: r.answer_text for r in N.render_overview(nodes, edges, starts, heads).collect()}
    assert over["YY-PL-002"] == "Inicio del árbol clínico YY-PL-002 v09 («Entrada»), en el orden del recorrido:\n\n- Medir ITU baja\n- ¿Fiebre? → Sí / No"
    assert over["XX-PL-001"].splitlines()[0].endswith("v03, en el orden del recorrido:")


def test_protocol_answers_and_nodes(spark):
    _, nodes, edges = S.tree_tables(spark, [catalog.TREE])
    said = spark.createDataFrame([(1, "XX-PL-001", "n1", "si"), (1, "XX-PL-001", "n3", "maybe"), (2, "XX-PL-001", "zz", "si")], "case_id long, protocol_id string, node_id string, value string")
    assert {r.case_id: r.answers for r in N.chosen_answers(said, edges).collect()} == {1: {"n1": "si"}, 2: {}}
    picked = spark.createDataFrame([(1, ["n6", "zz", "n6", "n0", "n2"]), (2, None), (3, [])], "qid long, ids array<string>")
    ranked = spark.createDataFrame([(q, "n4", 1) for q in (1, 2, 3)], "qid long, node_id string, rank int")
    assert sorted((r.qid, r.pos, r.node_id, r.by_model) for r in N.selected_nodes(picked, nodes, ranked).collect()) == [(1, 1, "n6", True), (1, 2, "n2", True), (2, 1, "n4", False), (3, 1, "n4", False)]
    asked = spark.createDataFrame([(1, "fever in a man of 70"), (2, "which fever dose"), (3, "nothing")], "qid long, question string")
    known = spark.createDataFrame([("XX-PL-001", ["fever"])], "protocol_id string, terms array<string>")
    assert sorted((r.qid, r.protocol_id, r.mode) for r in N.classified(asked, known).fillna("-").collect()) == [(1, "XX-PL-001", "caso"), (2, "XX-PL-001", "consulta"), (3, "-", "consulta")]
    verdicts = spark.createDataFrame([(1, " xx-pl-001 ", "Consulta"), (2, "zz", "what")], "qid long, protocol string, mode string")
    assert sorted((r.qid, r.protocol_id, r.mode) for r in N.classified(asked, known, verdicts).fillna("-").collect()) == [(1, "XX-PL-001", "consulta"), (2, "-", "caso"), (3, "-", "caso")]


def test_documents_and_tables(spark):
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "source_file string")
    known = S.catalog(spark, [{"file": "b-1.pdf", "source_type": "guia", "title": "B"}, {"file": "a.pdf", "source_type": "revision"}])
    assert [(r.source_file, r.source_type) for r in S.documents(files("z.pdf", "c.pdf"), files("b_1.pdf", "a.pdf"), known).orderBy("pos").collect()] == [("c.pdf", "institucional"), ("z.pdf", "institucional"), ("a.pdf", "revision"), ("b_1.pdf", "guia")]
    with pytest.raises(ValueError, match="not in the catalog"):
        S.documents(files("z.pdf"), files("x.pdf"), known)
    good = {"document": "d 1", "reviewed": True, "tables": [{"id": "t", "title": "T", "page": 2, "rows": [{"cells": {"a": 1, "b": None}, "notes": ["n"]}]}]}
    assert S.curated_tables(spark, [("d_1", good), ("e", None)]).first().rows[0].cells[0].val == "1"
    for wrong in ({"document": "e"}, {"reviewed": False}, {"tables": [{"id": "t"}]}):
        with pytest.raises(ValueError):
            S.curated_tables(spark, [("d_1", good | wrong)])


def test_store_and_index_round_trip(spark, tmp_path):
    df = chunks(spark, ["aa bb", "cc", "dd"]).withColumn("embedding", F.array(F.lit(1.0)))
    S.create_store(df, f"{tmp_path}/store")
    S.create_store(df.limit(1), f"{tmp_path}/store")
    assert S.scan_store(spark, f"{tmp_path}/store").count() == 3 and "embedding" not in S.scan_store(spark, f"{tmp_path}/store").columns
    I.build_index(df).save(f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "cc")], "qid long, question string")
    assert [r.chunk_id for r in I.bm25_search(I.Index.load(spark, f"{tmp_path}/index"), asked, 3).collect()] == [2]
    for _ in range(2):
        S.append_new(df.select("chunk_id"), f"{tmp_path}/log", "chunk_id", spark)
    assert spark.read.json(f"{tmp_path}/log").count() == 3


def test_catalog_errors(spark):
    with pytest.raises(ValueError):
        S.catalog(spark, [{"file": "x", "source_type": "blog"}])
    with pytest.raises(Exception, match="not in the catalog"):
        G.tagged(spark.createDataFrame([("x.pdf",)], "source_file string"), S.catalog(spark, [{"file": "y", "source_type": "guia"}])).collect()


def test_conversations_resume(spark, tmp_path):
    from lucerna.streaming.session import conversations, state_store

    state_store(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    _, nodes, edges = S.parse_tree(catalog.TREE)
    source = f"{tmp_path}/turns"
    schema = "thread_id string, turn int, reply string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = conversations(spark.readStream.schema(schema).parquet(source), nodes, edges)
        out = []
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        q.awaitTermination()
        return {r.thread_id: r for r in out}

    first = run([("t", 0, None), ("u", 0, None)])
    assert first["t"].status == N.PENDING and first["t"].node_id == "n1"
    second = run([("t", 1, "si"), ("u", 1, "no")])
    assert second["t"].node_id == "n3" and second["u"].status == N.COMPLETE
    third = run([("t", 2, "bajo")])
    assert third["t"].status == N.COMPLETE and json.loads(third["t"].answers) == {"n1": "si", "n3": "bajo"}


def test_entry_without_text_operators():
    import importlib
    import sys

    entry = importlib.import_module("__spark_entry__")
    hidden = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith(("lucerna.llm", "corpus_pipeline"))}
    sys.modules["lucerna.llm"] = sys.modules["corpus_pipeline"] = None
    try:
        importlib.reload(entry)
        assert "bm25_topk" in entry.queries() and not any(k.startswith("op") or k == "pipeline" for k in entry.queries())
    finally:
        for k in ("lucerna.llm", "corpus_pipeline"):
            sys.modules.pop(k, None)
        sys.modules.update(hidden)
        importlib.reload(entry)


def test_hybrid_queries_take_every_question_with_a_vector(spark, tmp_path, monkeypatch):
    from lucerna.plans.engine import Engine

    texts = [f"alpha{i} beta{i} gamma{i} delta{i}" for i in range(45)]
    spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, texts[i]) for i in (3, 19, 20, 31, 44)] + [(99, texts[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 6, [float(i == k) for k in range(45)]) for i in range(45)], "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(R, "hybrid_retrieve", lambda index, chunks, vectors, asked, **options: asked.select("qid", F.array_position("vector", 1.0).alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit("").alias("method")))
    monkeypatch.setattr(Engine, "answer", lambda self, asked: asked)
    want = [3, 19, 20, 31, 44]
    assert sorted((r.qid, r.chunk_id) for r in catalog.hybrid_retrieve(spark, str(tmp_path)).collect()) == [(i, i + 1) for i in want]
    assert sorted(r.qid for r in catalog.full_answer(spark, str(tmp_path)).collect()) == want


def test_dense_questions_in_blocks(spark, monkeypatch):
    rows = [(i, "guia" if i % 2 else R.INSTITUTIONAL, [float((i * k) % 7) for k in range(1, 5)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "chunk_id long, source_type string, embedding array<float>")
    asked = vectors.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    want = sorted(R.dense_search(vectors, asked, 3).collect())
    monkeypatch.setattr(R, "QUESTIONS", 4)
    assert sorted(R.dense_search(vectors, asked, 3).collect()) == want and len(want) == 3 * 14
    assert R.dense_search(vectors, asked.limit(0), 3).count() == 0


def test_dense_search_by_products(spark):
    """Matrix products only screen: scores, ties and odd vectors are those of the pairs, one by one."""
    import random

    import numpy as np

    from lucerna.operators import product
    from lucerna.operators.index import top_k

    draw = random.Random(5)
    vector = lambda: [draw.choice([0.125, -0.5, draw.uniform(-1, 1)]) for _ in range(16)]
    copied, near = vector(), vector()
    rows = [(i, copied if i % 9 == 0 else [x + 1e-7 * (i % 5) for x in near] if i % 9 == 1 else vector()) for i in range(700)]
    odd = [(700, None), (701, vector()[:5]), (702, [None, *vector()[1:]]), (703, [1e20] * 16)]
    vectors = spark.createDataFrame([(i, "guia", v) for i, v in rows + odd], "chunk_id long, source_type string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v) for i, v in rows[:40]] + [(900, None), (901, odd[1][1])], "qid long, vector array<double>")
    pairs = vectors.crossJoin(asked).select("qid", "chunk_id", R.dot("embedding", "vector").alias("score"))
    for digits in (5, 1, None):
        got = R.dense_search(vectors, asked, 7, digits=digits)
        assert sorted(map(repr, got.select("qid", "chunk_id", "score", "rank").collect())) == sorted(map(repr, top_k(pairs, 7, digits=digits).select("qid", "chunk_id", "score", "rank").collect()))
    halves = [0.000005, 1.000015, -0.000005, 2.5e-5, 0.1234549999, 0.123455, 1 / 3] + [draw.randrange(-300000, 300000) / 200000 for _ in range(300)]
    want = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(halves)], "i long, x double").orderBy("i").select(F.round("x", 5)).collect()]
    assert product.rounded(np.array(halves), 5).tolist() == want
    few = product.Best(np.array([copied]), 3, 5)
    for k in (0, 1):
        block = np.array([copied] * 50)
        few.merge(block, block.astype(np.float32), 4.0, np.arange(50) + 50 * (1 - k))
    assert few.ids.tolist() == [0, 1, 2]


def _of_sql(name, tmp_path):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    return sorted(tuple(r) for r in db.execute(catalog.ORACLE_SQL[name]).fetchall())


def test_anaphora_and_refusals_as_in_sql(spark, tmp_path):
    """Boundaries of words are those of the SQL, null turns come last, and every reply counts in the share of right refusals."""
    said = ["Esta dosis", "itè rapida", "estañol puede", "no ésta caso", "ñesta caso sube", "ESTE CASO", "they", "ItaliA", None, "", "como esta RECOMENDACIÓN", "x"]
    rows = [(c, t, "user", said[(c * 5 + t) % len(said)]) for c in range(12) for t in range(7)] + [(c, None, "user", said[c % 7]) for c in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, catalog.QUERIES["anaphora_islands"](spark, str(tmp_path)).collect())) == _of_sql("anaphora_islands", tmp_path)
    full = [r for r in rows if r[1] is not None and r[3] is not None]
    spark.createDataFrame(full, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["refusal_accuracy"](spark, str(tmp_path)).first()
    assert got.questions == len(full) and [tuple(got)] == _of_sql("refusal_accuracy", tmp_path)


def test_index_is_dealt_out_by_chunk(spark, monkeypatch):
    """Scores of questions are summed where a chunk's postings are: only the best rows of each task are shuffled, by question."""
    monkeypatch.setattr(I, "PART_CHUNKS", 5)
    rows = [(i % 37, f"alpha beta{i % 5} gamma{i % 7} alpha", "guia") for i in range(40)]
    index = I.build_index(spark.createDataFrame(rows, "chunk_id long, text string, source_type string"))
    asked = spark.createDataFrame([(1, "alpha gamma3"), (2, "beta1 beta1")], "qid long, question string")
    best = I.bm25_search(index, asked, 3)
    assert len(best.collect()) == 6
    plan = best._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert [line.count("hashpartitioning(qid") for line in plan.splitlines() if "Exchange hashpartitioning" in line] == [1] and "hashpartitioning(qid#" in plan and ", chunk_id" not in plan.partition("Exchange hashpartitioning(")[2].partition(")")[0]
    assert index.postings.rdd.getNumPartitions() == 8
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_index_keeps_a_chunk_in_one_row(spark, monkeypatch):
    """What is checkpointed for an index is a row a chunk; rows of one chunk and length are one chunk."""
    held, cut = [], I.lineage.cut

    def noted(df, dealt=False):
        out = cut(df, dealt)
        held.extend([out.count()] * dealt)
        return out

    monkeypatch.setattr(I.lineage, "cut", noted)
    rows = [(1, "bb aa aa", "guia"), (1, "aa cc aa", "guia"), (1, "cc", "guia"), (2, None, "guia"), (2, " ", "guia"), (3, "no no no", None), (None, "bb", "guia")]
    index = I.build_index(spark.createDataFrame(rows, "chunk_id long, text string, source_type string"))
    assert held == [5] == [index.lengths.count()]
    got = {(r.chunk_id, r.source_type, r.len, r.term, r.tf) for r in index.postings.collect()}
    assert got == {(1, "guia", 3, "aa", 4), (1, "guia", 3, "bb", 1), (1, "guia", 3, "cc", 1), (1, "guia", 1, "cc", 1), (3, None, 3, "no", 3), (None, "guia", 1, "bb", 1)}
    assert {(r.term, r.df) for r in index.terms.collect()} == {("aa", 1), ("bb", 2), ("cc", 2), ("no", 1)}
    assert [tuple(r) for r in index.stats.select("n", "terms").collect()] == [(5, 4)]


def test_pages_are_read_once(spark):
    """Running lines, cleaning and the deal of the sections share one look at each page, empty ones and odd ones included."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def looked(text):
        seen.add(1)
        return text

    rows = [("a", k, t) for k, t in enumerate(["# Uno\n" + "dosis diaria " * 30, "", None, " \n ", "sin titulo " * 40, "# Dos", "# Tres\n\n# Cuatro\n" + "otra cosa " * 600])]
    pages = spark.createDataFrame(rows, "source_file string, page int, text string")
    got = G.chunk_pages(pages.withColumn("text", looked("text"))).collect()
    assert seen.value == len(rows)
    assert sorted({(r.page, r.section) for r in got}) == [(0, "Uno"), (4, "Uno"), (6, "Cuatro")]
    assert sorted(r.chunk_index for r in got) == list(range(len(got))) and len(got) == 3
