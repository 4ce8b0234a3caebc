"""Grounding, verification, integration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.functions import words as W

APPROVED, REJECTED, UNVERIFIABLE = "aprobada", "rechazada", "no_verificable"
VERIFIED = "verificada"
"""Verdicts (fixed values)."""


def grounding_problems(answer: Column, files: Column, aliases: Column) -> Column:
    """G1: in this order: citations of unknown sources, marks of inference, talk of other sources over a single document."""
    known = F.concat(files, F.coalesce(aliases, F.array().cast("array<string>")))
    strange = F.filter(X.citations(answer), lambda c: ~F.exists(known, lambda f: X.cites(c, f)))
    guesses = X.inference_markers(answer)
    n_documents = F.size(F.array_distinct(F.transform(files, X.document_key)))
    found = F.array(
        F.when(F.size(strange) > 0, F.concat(F.lit("unknown citations: "), F.array_join(F.array_distinct(strange), ", "))),
        F.when(F.size(guesses) > 0, F.concat(F.lit("inference: "), F.array_join(guesses, ", "))),
        F.when(X.mentions_others(answer, n_documents), F.lit("speaks of other sources")),
    )
    return F.filter(found, lambda p: p.isNotNull())


def evaluated(answer: Column, problems: Column, judge: Column) -> Column:
    """Refusals are approved, problems rejected, else the judge (true, false, null: unreadable after two tries) decides; fails closed."""
    return F.when(X.is_refusal(answer), APPROVED).when(F.size(problems) > 0, REJECTED).when(judge.isNull(), UNVERIFIABLE).when(judge, APPROVED).otherwise(REJECTED)


def admitted(judge: Column) -> Column:
    """An unreadable verdict admits."""
    return F.coalesce(judge, F.lit(True))


def retry_rows(rows: DataFrame) -> DataFrame:
    """O2, A.8: rejected once, without an error, and not retried yet."""
    return rows.where((F.col("eval_status") == REJECTED) & (F.col("retry_count") < 1) & F.col("error").isNull())


def complete_citation(c: Column) -> Column:
    """P14."""
    return (F.trim(X.text(c["source_file"])) != "") & c["page"].isNotNull() & (F.trim(X.text(c["verbatim_text"])) != "")


def verify_tree(error: Column, protocol: Column, content: Column, outcome: Column, cites: Column) -> Column:
    """struct<status, verification, eligible>; one complete citation is enough."""
    status = F.when(error.isNotNull(), "error_tecnico").when(protocol.isNull(), "sin_protocolo").when(content.isNull(), F.coalesce(outcome, F.lit("sin_resultado"))).otherwise("resultado")
    whole = F.exists(cites, complete_citation)
    verification = F.when(status != "resultado", F.lit(None)).when(whole, VERIFIED).otherwise("citas_incompletas")
    return F.struct(status.alias("status"), verification.alias("verification"), F.coalesce(verification == VERIFIED, F.lit(False)).alias("eligible"))


def verify_rag(error: Column, answer: Column, n_sources: Column, eval_status: Column, provenance: Column) -> Column:
    """struct<status, verification, eligible>; the first that holds: error, refusal, no sources, not verifiable, rejected, no provenance."""
    status = F.when(error.isNotNull(), "error_tecnico").when(X.is_refusal(answer), "abstencion").when(n_sources < 1, "sin_fuentes").otherwise("resultado")
    verification = F.when(status != "resultado", F.lit(None)).when(eval_status == UNVERIFIABLE, UNVERIFIABLE).when(eval_status == REJECTED, "rechazada_por_evaluador").when(~provenance, "sin_procedencia").otherwise(VERIFIED)
    return F.struct(status.alias("status"), verification.alias("verification"), F.coalesce(verification == VERIFIED, F.lit(False)).alias("eligible"))


def related(tree: Column, judge: Column, chosen_by_model: Column) -> Column:
    """A walk is published only if judged related, unless its nodes were chosen for this question; fails closed."""
    ok = chosen_by_model | F.coalesce(judge, F.lit(False))
    verification = F.when(~tree["eligible"] | ok, tree["verification"]).when(judge.isNull(), UNVERIFIABLE).otherwise("no_relacionada")
    return F.struct(tree["status"].alias("status"), verification.alias("verification"), (tree["eligible"] & ok).alias("eligible"))


def contradiction(judge: Column) -> Column:
    """A note if the judge finds one or cannot be read."""
    return F.when(judge.isNull(), "could not check for contradictions").when(judge, "the contributions contradict each other")


def file_versions(rows: DataFrame) -> DataFrame:
    """(qid, agent, code, versions) from cited file names; v3 and v03 are one version."""
    code = F.regexp_extract(F.upper("source_file"), W.CODE, 1)
    digits = F.regexp_extract(F.lower("source_file"), r"(?:^|[^a-z])v([0-9]+)", 1)
    version = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    named = rows.select("qid", "agent", code.alias("code"), version.alias("version")).where("code <> '' AND version <> ''")
    return named.groupBy("qid", "agent", "code").agg(F.array_sort(F.collect_set("version")).alias("versions"))


def version_discrepancies(rows: DataFrame) -> DataFrame:
    """(qid, code, arbol, rag) of codes that both agents cite in different versions; rows are of eligible agents."""
    held = file_versions(rows)
    tree = held.where("agent = 'arbol'").select("qid", "code", F.col("versions").alias("arbol"))
    rag = held.where("agent = 'rag'").select("qid", "code", F.col("versions").alias("rag"))
    return tree.join(rag, ["qid", "code"]).where("arbol <> rag")


#: Fixed value: what stands before the notes on sources.
NOTE = "**Nota sobre las fuentes:** "


def annotated(text: Column, notes: Column) -> Column:
    """A text with the notes (array) on versions and contradictions below it, if there are any."""
    return F.when(F.size(notes) > 0, F.concat(text, F.lit("\n\n" + NOTE), F.array_join(notes, " "))).otherwise(text)


def version_notes(discrepancies: DataFrame) -> DataFrame:
    """(qid, notes) of `version_discrepancies`, a sentence for each code, by code."""
    listed = lambda c: F.array_join(F.array_sort(c), ", ")
    note = F.concat(F.lit("El arbol de decision usa "), "code", F.lit(" version "), listed("arbol"), F.lit(" y los documentos recuperados citan "), "code", F.lit(" version "), listed("rag"), F.lit("."))
    pairs = F.array_sort(F.collect_list(F.struct("code", note.alias("note"))))
    return discrepancies.groupBy("qid").agg(F.transform(pairs, lambda p: p["note"]).alias("notes"))


def integrate(contributions: DataFrame, fallback: str = W.REFUSAL_TEXT) -> DataFrame:
    """(qid, text, n_blocks): eligible blocks, tree first; one stands alone, two get titles; none gives the abstention or the fallback."""
    place = F.when(F.col("agent") == "arbol", 0).otherwise(1)
    block = F.struct(place.alias("place"), F.col("agent"), F.col("content"))
    rows = contributions.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("eligible"), block))).alias("blocks"),
        F.max(F.when((F.col("agent") == "rag") & (F.col("status") == "abstencion"), F.col("content"))).alias("abstained"),
    )
    title = lambda b: F.when(b["agent"] == "arbol", "**Arbol de decision**\n").otherwise("**Documentos**\n")
    text = F.when(F.size("blocks") == 0, F.coalesce("abstained", F.lit(fallback))).when(F.size("blocks") == 1, F.get("blocks", F.lit(0))["content"])
    text = text.otherwise(F.array_join(F.transform("blocks", lambda b: F.concat(title(b), b["content"])), "\n\n"))
    return rows.select("qid", text.alias("text"), F.size("blocks").alias("n_blocks"))


STATUS_LABELS = {"resultado": "with a result", "error_tecnico": "technical error", "sin_protocolo": "no protocol applies", "abstencion": "abstained", "sin_fuentes": "no sources", "sin_resultado": "no result", "informacion_faltante": "information is missing", "ausencia_de_coincidencias": "no matching branch"}


def panels(contributions: DataFrame) -> DataFrame:
    """One row per agent: label of its status, content or the reason for none, sources only if eligible."""
    label = F.col("status")
    for key, shown in STATUS_LABELS.items():
        label = F.when(F.col("status") == key, shown).otherwise(label)
    reason = F.concat(F.lit("not published: "), F.coalesce("verification", "status"))
    return contributions.select("qid", "agent", label.alias("label"), F.when(F.col("eligible"), F.col("content")).otherwise(reason).alias("content"), F.when(F.col("eligible"), F.col("n_sources")).otherwise(0).alias("n_sources"))


def final_text(rejection: Column, integrated: Column, answer: Column, eval_status: Column, fallback: str = W.REFUSAL_TEXT) -> Column:
    """The rejection, else the integrated text, else an approved answer, else the fallback."""
    return F.coalesce(rejection, integrated, F.when(eval_status == APPROVED, answer), F.lit(fallback))
