"""Word lists and patterns of the text functions; all of them are defaults that callers may replace."""

from __future__ import annotations

#: Function words, folded. Negations (no, not, sin, ni, nicht, kein, ne, pas, never) are left out on purpose.
STOP = {
    "es": "a al ante como con cual cuando de del desde donde el ella en entre es esta este esto ha hay la las lo los mas o para pero por que se segun ser si sobre son su sus tras un una y ya",
    "en": "a an and are as at be been by can do does for from has have how if in into is it its of on or our such than that the their then there these this those to was were what when where which who will with",
    "fr": "au aux avec ce ces dans de des du elle en est et il la le les leur ou par pour que qui sa se ses son sur un une",
    "de": "als am an auf aus bei das dem den der des die durch ein eine einem einen einer es fur im in ist mit oder sich sie sind und von vor war wie zu zum zur",
}
STOPWORDS = sorted({w for words in STOP.values() for w in words.split()})

#: Words that speak of the collection itself rather than of its subject.
META = "capitulo chapter chunk corpus document documento documentos documents file fuente guia guias guide guideline pagina page protocol protocolo seccion section source table tabla".split()
#: Words too general to carry a question alone.
GENERIC = "case caso casos cases general information informacion manejo management patient patients paciente pacientes pregunta question recommendation recomendacion tratamiento treatment uso use".split()
#: Endings and words that look like verbs.
VERB_ENDINGS = "aria arian ando iendo ing ized ises".split()
VERB_WORDS = "debe deben hace hacer puede pueden should tiene tienen would".split()

#: Votes for a language.
ENGLISH_VOTE = "and are for from in is of or that the to was were with".split()
SPANISH_VOTE = "al con de del el en la las los para por que se una y".split()

#: A reply with one of these and at most REFUSAL_WORDS words is a refusal.
REFUSAL_MARKERS = ["no encuentro", "no se encuentra", "no dispongo de", "not found in the sources", "cannot answer", "no information available"]
REFUSAL_WORDS = 60
REFUSAL_TEXT = "No se encuentra esa informacion en las fuentes."

#: Phrases that mark a guess.
INFERENCE = ["could be inferred", "it is likely that", "podria inferirse", "presumably", "probably", "probablemente", "se puede suponer", "supposedly"]
# Fixed values, over folded text: phrases for other sources, phrases for several at once, and what negates the former within NEGATION_REACH characters before.
OTHER_SOURCES = r"\b(otras|algunas|diferentes|distintas|demas|varias)\s+(guias|fuentes|protocolos)\b"
SOURCES_TOGETHER = r"\b(ambas|las dos)\s+(guias|fuentes|protocolos)\b|\b(guias|fuentes|protocolos)\s+(\w+\s+){0,2}(coinciden|concuerdan)\b|\b(guias|fuentes|protocolos)\b(\s+\w+){0,8}\s+(presentan|dan|tienen|ofrecen|hacen)\s+las\s+mismas\b"
NEGATION = r"(no hay|no existen|ninguna|sin|no se encontraron)\s+(\w+\s+){0,2}$"
NEGATION_REACH = 30

#: Beginnings of administrative sections, and the word by whose first letters a question names them.
ADMIN = {
    "objetivo": "objetivo",
    "alcance": "alcance",
    "introduccion": "introduccion",
    "epidemiologia": "epidemiologia",
    "epidemilogia": "epidemiologia",
    "recopilacion de la evidencia": "evidencia",
    "criterio de clasificacion": "clasificacion",
    "control de cambios": "cambios",
    "plan de delegacion": "delegacion",
    "necesidades de investigacion": "investigacion",
    "esta guia no aplica": "aplica",
    "metodologia": "metodologia",
    "poblacion de interes": "poblacion",
    "usuarios de la guia": "usuarios",
    "usuarios a quienes se dirige": "usuarios",
    "methods": "metodo",
    "research needs": "investigacion",
    "outstanding research": "investigacion",
    "conclusions and research needs": "investigacion",
    "controversies and uncertainties": "controversia",
    "resumen": "resumen",
    "abstract": "resumen",
    "summary": "resumen",
    "introduction": "introduccion",
    "conclusion": "conclusion",
    "overview": "resumen",
}
ADMIN_STEM = 7
#: A document's header, what a question about it names, and the section that holds a table of changes.
DOCUMENT_HEADER = r"(?s)proceso:.*codigo:\s*ct-pl"
HEADER_WORDS = "version|codigo|fecha"
CHANGE_CONTROL = "control de cambios"
ADMIN_PENALTY = 0.2

# Lines that are stamps or contacts, whole, and the foot lines that a house prints on each page, of whatever house.
STAMP_LINE = r"(?iU)[\w.+-]+\s?@\s?[\w-]+(\s?\.[\w-]+)+|can be contacted at|address correspondence|descargado para|downloaded (from|for|by)\b|para uso personal exclusivamente|for personal use only|for the private, non-?commercial|reprint orders|autor para correspondencia|correspondence:|corresponding author"
BOILERPLATE = (
    r"(?iU)_?El contenido de este documento es de propiedad y de uso exclusivo de la [^.\n_]+\.?_?\.?",
    r"(?iU)\**_?Cualquier impresi[oó]n o copia tomada de este documento se considera como COPIA NO CONTROLADA_?\**",
    r"(?iU)\**\s*P[aá]gina\s+\d+\s+de\s+\d+\s*\**",
)
#: A bibliographic reference: a year, and pages, et al., a volume or a DOI.
REFERENCE_LINE = r"(?i)((19|20)[0-9]{2}.*(et al|[0-9]+ ?\([0-9]+\)|: ?[0-9]+ ?[-–] ?[0-9]+|doi))|^\s*\[?[0-9]{1,3}[.\]].*(19|20)[0-9]{2}"
BIBLIOGRAPHY_TITLE = r"(?i)^[0-9. ]*(bibliograf|bibliograph|referencias|references|literatur|acknowledg|agradecimient)"
CITATION = r"\[Guia: ([^\],]+)"
CODE = r"([A-Z]{2}-[A-Z]{2}-[0-9]+)"
DEFAULT_SECTION = "Sin seccion"
"""Title of text without a heading (a fixed value of the data model)."""
#: Words that a question to a decision tree shares with most of its nodes, and one word for words of one meaning; both depend on the trees and may be replaced.
NODE_STOP = sorted({*STOPWORDS, *META, *GENERIC, *"adulto adultos cual cuales cuando debe deben decidir diferencias disponibles donde enfoque entre existe existen inicial recomendaciones recomendado recomienda situaciones".split()})
NODE_SYNONYMS = {"pseudomonas": "aeruginosa"}
#: Phrases of a reply that abstains, of any length.
ABSTENTION = ["no encontr", "no cubr", "no teng", "no dispon", "informacion suficiente"]
