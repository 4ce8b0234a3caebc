"""A set of questions through both agents, the tree and the documents, to one text each.

Admitted questions go to two branches, DataFrame functions of their own; what they
give is joined at a barrier, verified and put together. A branch's failure is its
rows' `error`, and the other branch's rows are published without it. Answers that
the evaluator rejects, and only they, go through the documents' branch once more.

Every model is optional and any function from a prompt to a reply
(`operators.model`); a reply that can't be read has the fail rule of its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.functions import words as W
from lucerna.operators import answer as A
from lucerna.operators import flow as N
from lucerna.operators import index as I
from lucerna.operators import lineage
from lucerna.operators import model as M
from lucerna.operators import verify as V

Client = Callable[[str], str]

#: Times that a failing branch is tried on parts of its rows.
ATTEMPTS = 32

# Outcomes of a walk that gives no result, and the sentences that say why.
MISSING, NO_MATCH = "informacion_faltante", "ausencia_de_coincidencias"
CITATION = "array<struct<source_file:string,section:string,page:int,verbatim_text:string>>"
TREE = f"qid long, protocol_id string, rule_id string, content string, outcome string, detail string, citations {CITATION}, chosen_by_model boolean, error string"
RAG = "qid long, answer string, sources array<struct<source_file:string,section:string,page:int>>, eval_status string, problems array<string>, retry_count int, error string"
INSTRUCTION = ("Tu respuesta anterior fue rechazada por este motivo: ", ". Responde de nuevo, mas literal: usa solo texto que aparezca en el CONTEXTO y di si no hay informacion suficiente.")
QUESTION, CONTEXT, EXTRA = "PREGUNTA:\n", "CONTEXTO:\n", "INSTRUCCION ADICIONAL:\n"


@dataclass
class Trees:
    """heads (protocol_id, version, name, description, source_file, terms array<string>), nodes and edges."""

    heads: DataFrame
    nodes: DataFrame
    edges: DataFrame


@dataclass
class Models:
    """The models of a run; without one, its place has the offline default or is left out."""

    admit: Client | None = None
    classify: Client | None = None
    extract: Client | None = None
    select: Client | None = None
    generate: Client | None = None
    evaluate: Client | None = None
    relate: Client | None = None
    contradict: Client | None = None


def isolated(branch: Callable[[DataFrame], DataFrame], rows: DataFrame, schema: str) -> DataFrame:
    """What a branch gives for rows (qid, ...), by name as in `schema`; rows on which it fails have only `qid` and `error`.

    If the branch fails on a set of rows, it is tried on the halves of it (by a
    hash of qid), down to the rows that it fails on alone or until ATTEMPTS are
    used up. A branch that fails for whatever reason so costs its own rows only.
    """
    spark, left = rows.sparkSession, ATTEMPTS
    names = [c.name for c in spark.createDataFrame([], schema).schema]
    done, open_ = [], [(lineage.cut(rows), 0)]
    while open_:
        part, depth = open_.pop()
        left -= 1
        try:
            done.append(lineage.cut(branch(part).select(*names)))
        except Exception as e:  # noqa: BLE001  whatever a branch meets is its rows' error
            halves = [part.where(F.pmod(F.shiftright(F.xxhash64("qid"), depth), F.lit(2)) == h) for h in (0, 1)]
            if left > 0 and depth < 60 and part.limit(2).count() > 1:
                open_ += [(h, depth + 1) for h in halves]
            else:
                why = f"{M.TECHNICAL}: {type(e).__name__}"
                done.append(part.select("qid").join(spark.createDataFrame([], schema).drop("error"), "qid", "left").withColumn("error", F.lit(why)).select(*names))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _read(rows: DataFrame, client: Client | None, prompt: Column, field: str, kind: str, tries: int = 1) -> DataFrame:
    """The rows with `said`: the field of the model's JSON reply, null if there is no model or it can't be read in `tries`."""
    if client is None:
        return rows.withColumn("said", F.lit(None).cast(kind))
    schema = f"struct<{field}:{kind}>"
    out, left = None, rows.withColumn("_prompt", prompt)
    for k in range(tries):
        got = lineage.cut(M.asked(left, client, "_prompt").withColumn("said", F.from_json("reply", schema)[field]).drop("reply", "error"))
        last = k == tries - 1
        read = got if last else got.where("said IS NOT NULL")
        out = read if out is None else out.unionByName(read)
        if not last:
            left = got.where("said IS NULL").drop("said")
    return out.drop("_prompt")


def _question(c: str = "question") -> Column:
    return F.concat(F.lit(QUESTION), F.col(c))


# --- the tree's branch


def classifier_prompt(heads: DataFrame) -> str:
    """what a classifier is told: the protocols that there are, by id, name and scope, and the two modes."""
    listed = [f"- {r.protocol_id}: {r.name} ({r.description})" for r in heads.select("protocol_id", "name", "description").orderBy("protocol_id").collect()]
    return "\n".join(["Protocolos institucionales, por su id:", *listed, "NINGUNO si ninguno corresponde.", "MODO: caso (un paciente concreto) o consulta (informacion general); ante la duda, caso.", 'Responde con JSON: {"protocol": "<id o NINGUNO>", "modo": "caso"}.', ""])


def _classified(questions: DataFrame, trees: Trees, client: Client | None) -> DataFrame:
    if client is None:
        return N.classified(questions, trees.heads)
    got = M.asked(questions.select("qid", F.concat(F.lit(classifier_prompt(trees.heads)), _question()).alias("prompt")), client)
    said = F.from_json("reply", "struct<protocol:string,modo:string>")
    return N.classified(questions, trees.heads, lineage.cut(got.select("qid", said["protocol"].alias("protocol"), said["modo"].alias("mode"))))


def _answers(cases: DataFrame, trees: Trees, client: Client | None) -> DataFrame:
    """(qid, protocol_id, answers): what the question's text says of the protocol's decisions; only labels count."""
    none = cases.select("qid", "protocol_id", F.create_map().cast("map<string,string>").alias("answers"))
    if client is None:
        return none
    order = N.decisions_in_order(N.routes(trees.edges, trees.nodes.where(F.col("kind") == N.START).select("protocol_id", "node_id")), trees.nodes)
    labels = N.traversable(trees.edges).groupBy("protocol_id", F.col("source").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_pos", X.text("label").alias("label")))), lambda x: x["label"]), " | ").alias("labels"))
    line = F.concat(F.lit("- "), "node_id", F.lit(": "), X.headline("text"), F.lit(" ["), "labels", F.lit("]"))
    listed = order.join(labels, ["protocol_id", "node_id"]).groupBy("protocol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("catalog"))
    asked = cases.join(I.small(lineage.cut(listed)), "protocol_id")
    got = M.asked(asked.select("qid", "protocol_id", F.concat("catalog", F.lit("\n"), _question()).alias("prompt")), client)
    said = lineage.cut(got.select("qid", "protocol_id", F.explode(F.from_json("reply", "map<string,string>")).alias("node_id", "value")))
    chosen = N.chosen_answers(said.withColumnRenamed("qid", "case_id"), trees.edges).select(F.col("case_id").alias("qid"), F.col("answers").alias("_a"))
    return none.join(chosen, "qid", "left").select("qid", "protocol_id", F.coalesce("_a", "answers").alias("answers"))


def _of_cases(cases: DataFrame, trees: Trees, client: Client | None) -> DataFrame:
    answers = _answers(cases, trees, client)
    walks = lineage.cut(N.walk_cases(answers.withColumnRenamed("qid", "case_id"), trees.nodes, trees.edges))
    whole = walks.where(F.col("status") == N.COMPLETE)
    done = N.render(whole, trees.nodes, trees.heads).select(F.col("case_id").alias("qid"), "rule_id", F.col("answer_text").alias("content"), "citations")
    stopped = walks.where(F.col("status") != N.COMPLETE).join(I.small(trees.nodes.select("protocol_id", F.col("node_id").alias("stopped_at"), "text")), ["protocol_id", "stopped_at"], "left")
    at, lost = X.headline("text"), F.col("status") == N.NO_ROUTE
    detail = F.when(lost, F.concat(F.lit("el caso no cumple ninguna de las opciones del diagrama en «"), at, F.lit("»."))).otherwise(F.concat(F.lit("falta el dato para responder «"), at, F.lit("».")))
    stopped = stopped.select(F.col("case_id").alias("qid"), F.when(lost, NO_MATCH).otherwise(MISSING).alias("outcome"), detail.alias("detail"))
    return cases.select("qid", "protocol_id").join(done, "qid", "left").join(stopped, "qid", "left").withColumn("chosen_by_model", F.lit(False))


def _of_consultations(asked: DataFrame, trees: Trees, client: Client | None) -> DataFrame:
    starts = trees.nodes.where(F.col("kind") == N.START).select("protocol_id", "node_id")
    own = trees.nodes.where(F.col("kind") != N.START)
    ranked = I.rank_nodes(trees.nodes, asked)
    listed = own.groupBy("protocol_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "node_id", F.lit(" ["), F.coalesce(F.nullif("section", F.lit("")), F.nullif("source_ref", F.lit("")), "kind"), F.lit("]: "), F.substring(X.headline("text"), 1, 140)))), "\n").alias("catalog"))
    prompt = F.concat("catalog", F.lit("\n"), _question())
    selected = _read(asked.join(I.small(lineage.cut(listed)), "protocol_id"), client, prompt, "nodos", "array<string>").select("qid", F.col("said").alias("ids"))
    # ids of other protocols are unknown to this one
    chosen = N.selected_nodes(selected, trees.nodes, ranked).join(asked.select("qid", "protocol_id"), "qid").join(I.small(own.select("protocol_id", "node_id")), ["protocol_id", "node_id"], "left_semi")
    chosen = lineage.cut(chosen)
    consult = N.render_consult(chosen, trees.nodes, trees.edges, starts, trees.heads).select("qid", "rule_id", F.col("answer_text").alias("content"), "citations")
    by_model = chosen.groupBy("qid").agg(F.bool_or("by_model").alias("chosen_by_model"))
    over = N.render_overview(trees.nodes, trees.edges, starts, trees.heads).select("protocol_id", F.col("answer_text").alias("_text"), F.col("citations").alias("_cites"))
    rows = asked.select("qid", "protocol_id").join(consult, "qid", "left").join(by_model, "qid", "left").join(I.small(lineage.cut(over)), "protocol_id", "left")
    return rows.select("qid", "protocol_id", "rule_id", F.coalesce("content", "_text").alias("content"), F.coalesce("citations", "_cites").alias("citations"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("detail"), F.coalesce("chosen_by_model", F.lit(False)).alias("chosen_by_model"))


def tree_branch(trees: Trees, models: Models) -> Callable[[DataFrame], DataFrame]:
    """Questions (qid, question) as in TREE: a case is walked, a consultation shown, no protocol no content."""

    def run(questions: DataFrame) -> DataFrame:
        kinds = lineage.cut(questions.select("qid", "question").join(_classified(questions, trees, models.classify), "qid"))
        own = kinds.where("protocol_id IS NOT NULL")
        names = ["qid", "protocol_id", "rule_id", "content", "outcome", "detail", "citations", "chosen_by_model"]
        found = _of_cases(own.where("mode = 'caso'"), trees, models.extract).select(*names)
        found = found.unionByName(_of_consultations(own.where("mode = 'consulta'"), trees, models.select).select(*names))
        file = I.small(trees.heads.select("protocol_id", "source_file"))
        cite = F.transform("citations", lambda c: F.struct(F.col("source_file"), c["section"].alias("section"), F.lit(1).alias("page"), c["verbatim_text"].alias("verbatim_text")))
        found = found.join(file, "protocol_id", "left").withColumn("citations", cite).drop("source_file", "protocol_id")
        return kinds.select("qid", "protocol_id").join(found, "qid", "left").withColumn("error", F.lit(None).cast("string"))

    return run


# --- the documents' branch


def rag_branch(retrieve: Callable[[DataFrame], DataFrame], models: Models) -> Callable[[DataFrame], DataFrame]:
    """Questions (qid, question) as in RAG: retrieved, answered and evaluated; a rejected answer is made and evaluated once more (O2).

    `retrieve` gives (qid, rank, chunk_id, source_file, source_type, section,
    page, text) for questions. Without `models.generate` an answer is the
    retrieved texts' context itself. An unreadable verdict, after two tries, is no
    rejection, so it is not answered again; without `models.evaluate` what has
    no grounding problem is approved.
    """

    def run(questions: DataFrame) -> DataFrame:
        found = lineage.cut(retrieve(questions.select("qid", "question")))
        held = A.context(found).join(found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_file", "section", "page"))), lambda x: F.struct(x["source_file"].alias("source_file"), x["section"].alias("section"), x["page"].alias("page"))).alias("sources")), "qid")
        asked = lineage.cut(questions.select("qid", "question").join(held, "qid", "left"))
        first = evaluated(generated(asked.withColumn("instruction", F.lit(None).cast("string")), models.generate), models.evaluate).withColumn("retry_count", F.lit(0))
        first = lineage.cut(first)
        again = V.retry_rows(first)
        why = F.concat(F.lit(INSTRUCTION[0]), F.coalesce(F.nullif(F.array_join("problems", "; "), F.lit("")), F.lit("la respuesta no estaba bien fundamentada")), F.lit(INSTRUCTION[1]))
        second = again.withColumn("instruction", why).select(*asked.columns, "instruction")
        second = evaluated(generated(second, models.generate), models.evaluate).withColumn("retry_count", F.lit(1))
        second = lineage.cut(second)
        kept = first.join(second.select("qid"), "qid", "left_anti").unionByName(second)
        page = F.transform("sources", lambda s: F.struct(s["source_file"].alias("source_file"), s["section"].alias("section"), s["page"].cast("int").alias("page")))
        return kept.withColumn("sources", page)

    return run


def generated(asked: DataFrame, client: Client | None) -> DataFrame:
    """Rows (qid, question, context, sources, instruction) with `answer` and `error`; without sources the answer is the refusal, and no model is asked."""
    if client is None:
        said = asked.withColumns({"reply": F.col("context"), "error": F.lit(None).cast("string")})
    else:
        extra = F.coalesce(F.concat(F.lit("\n\n" + EXTRA), "instruction"), F.lit(""))
        prompt = F.when(F.col("sources").isNotNull(), F.concat(F.lit(CONTEXT), "context", extra, F.lit("\n\n"), _question()))
        said = M.asked(asked.withColumn("_prompt", prompt), client, "_prompt").drop("_prompt")
    answer = F.when(F.col("error").isNull(), F.coalesce(F.trim("reply"), F.lit(W.REFUSAL_TEXT)))
    return said.withColumn("answer", answer).drop("reply")


def evaluated(rows: DataFrame, client: Client | None) -> DataFrame:
    """The rows with `problems` and `eval_status`; rows with an error, which have no answer to judge, have neither."""
    files = F.coalesce(F.transform("sources", lambda s: s["source_file"]), F.array().cast("array<string>"))
    found = rows.withColumn("problems", F.when(F.col("error").isNull(), V.grounding_problems(F.col("answer"), files, F.lit(None).cast("array<string>"))))
    open_ = (F.size("problems") == 0) & ~X.is_refusal("answer")
    found = lineage.cut(found.withColumn("_open", F.coalesce(open_, F.lit(False))))
    if client is None:
        judged = found.withColumn("said", F.lit(True))
    else:
        prompt = F.concat(F.lit(CONTEXT), "context", F.lit("\n\nRESPUESTA:\n"), "answer", F.lit("\n\n"), _question())
        # only the prompt's columns go to the judge, and only answers that are open
        said = _read(found.where("_open").select("qid", "context", "answer", "question"), client, prompt, "ok", "boolean", 2)
        judged = found.join(said.select("qid", "said"), "qid", "left")
    status = F.when(F.col("error").isNull(), V.evaluated(F.col("answer"), F.col("problems"), F.col("said")))
    return judged.withColumn("eval_status", status).drop("_open", "said")


# --- both


def agents(questions: DataFrame, trees: Trees, retrieve: Callable[[DataFrame], DataFrame], models: Models | None = None, rejection: str = W.REFUSAL_TEXT) -> DataFrame:
    """O1: a row for each question (qid, question; qids are unique integers): qid, text, n_blocks, tree_status, tree_verification, rag_status, rag_verification, retry_count, tree_error, rag_error.

    Questions that are not admitted get the rejection and reach no branch. A
    tree's text is published only if it is judged to fit the question, or a
    model chose its nodes for it; without `models.relate` all fit. Notes on
    versions and contradictions stand below two published texts.
    """
    models = models or Models()
    asked = _read(questions.select("qid", "question"), models.admit, _question(), "ok", "boolean", 2)
    asked = lineage.cut(asked.select("qid", "question", V.admitted(F.col("said")).alias("admitted")))
    inside = asked.where("admitted").select("qid", "question")
    tree = isolated(tree_branch(trees, models), inside, TREE)
    rag = isolated(rag_branch(retrieve, models), inside, RAG)
    rows = inside.join(tree.withColumnsRenamed({"error": "tree_error"}), "qid", "left").join(rag.withColumnsRenamed({"error": "rag_error"}), "qid", "left")
    tree_state = V.verify_tree(*(F.col(c) for c in ("tree_error", "protocol_id", "content", "outcome", "citations")))
    whole = F.exists("sources", lambda s: (F.trim(X.text(s["source_file"])) != "") & s["page"].isNotNull())
    rag_state = V.verify_rag(F.col("rag_error"), F.col("answer"), F.coalesce(F.size("sources"), F.lit(0)), F.col("eval_status"), F.coalesce(whole, F.lit(False)))
    rows = lineage.cut(rows.withColumns({"tree": tree_state, "rag": rag_state}))
    if models.relate is not None:
        unsure = rows.where("tree.eligible AND NOT chosen_by_model").select("qid", "question", "content")
        said = _read(unsure, models.relate, F.concat(F.lit("APORTACION ARBOL:\n"), "content", F.lit("\n\n"), _question()), "relacionada", "boolean", 2)
        rows = rows.join(said.select("qid", "said"), "qid", "left")
    else:
        rows = rows.withColumn("said", F.lit(True))
    rows = lineage.cut(rows.withColumn("tree", V.related(F.col("tree"), F.col("said"), F.coalesce("chosen_by_model", F.lit(False)))).drop("said"))
    each = rows.select("qid", F.inline(F.array(_contribution("arbol", "tree", "content"), _contribution("rag", "rag", "answer"))))
    text = V.integrate(each)
    both = rows.where("tree.eligible AND rag.eligible")
    cited = both.select("qid", F.lit("arbol").alias("agent"), F.explode("citations.source_file").alias("source_file")).union(both.select("qid", F.lit("rag"), F.explode("sources.source_file")))
    notes = V.version_notes(V.version_discrepancies(cited))
    if models.contradict is not None:
        prompt = F.concat(F.lit("APORTACION ARBOL:\n"), "content", F.lit("\n\nAPORTACION RAG:\n"), "answer", F.lit("\n\n"), _question())
        said = _read(both.select("qid", "question", "content", "answer"), models.contradict, prompt, "contradiccion", "boolean", 2)
        found = said.select("qid", V.contradiction(F.col("said")).alias("note")).where("note IS NOT NULL")
        notes = notes.select("qid", F.posexplode("notes").alias("pos", "note")).unionByName(found.select("qid", F.lit(1 << 20).alias("pos"), "note"))
        notes = notes.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "note"))), lambda n: n["note"]).alias("notes"))
    shown = rows.select("qid", *(F.col(f"{a}.{c}").alias(f"{a}_{c}") for a in ("tree", "rag") for c in ("status", "verification")), "retry_count", "tree_error", "rag_error")
    out = asked.select("qid", "admitted").join(text, "qid", "left").join(notes, "qid", "left").join(shown, "qid", "left")
    said = V.annotated(F.col("text"), F.coalesce("notes", F.array().cast("array<string>")))
    return out.select("qid", F.when(F.col("admitted"), said).otherwise(rejection).alias("text"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), *shown.columns[1:])


def _contribution(agent: str, state: str, content: str) -> Column:
    return F.struct(F.lit(agent).alias("agent"), F.col(f"{state}.status").alias("status"), F.col(f"{state}.verification").alias("verification"), F.col(f"{state}.eligible").alias("eligible"), F.col(content).alias("content"))
