"""How a sentence holds what it says: negation by kind, and whether it is stated at all.

A sentence comes as two strings, what stands before and from the focus on: its tokens, plain and lower-case, each between
single spaces, with | where a comma, a colon or a line's end stood. All readings are regular expressions over these, so
they run within Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.relation_rules import STOP_FORMS
from ledgerloom.functions.scores import codes, first_that

# Fixed values, to REPORT_HOMOGRAPHS: words and phrases that negate, bound, or frame what a sentence says.
NEGATIONS, NEVER, WINDOW, CESSATION_WINDOW = ("no", "nunca", "jamas", "tampoco", "ni"), ("nunca", "jamas"), 3, 3
NOT_YET = ("todavia no", "aun no", "no todavia")
RELATIONAL_VERBS = (
    "pertenecer", "militar", "integrar", "formar", "figurar", "constar", "liderar", "dirigir", "encabezar", "presidir", "capitanear", "comandar", "gobernar", "reinar", "mandar", "servir", "obedecer", "acatar",
    "apoyar", "colaborar", "cooperar", "poseer", "ostentar", "regentar", "depender", "representar", "ser", "estar",
)
RELATIONAL_NOUNS = (
    "alianza", "alianzas", "pacto", "pactos", "acuerdo", "acuerdos", "vinculo", "vinculos", "lazo", "lazos", "union", "sociedad", "amistad", "rivalidad", "enemistad", "servidumbre", "vasallaje", "militancia",
    "pertenencia", "membresia", "afiliacion", "adscripcion", "lealtad", "juramento", "compromiso", "obediencia", "fidelidad", "cargo", "puesto", "presidencia", "direccion", "jefatura", "mando", "liderazgo",
    "capitania", "regencia", "magistratura",
)
DETERMINERS = (
    "el", "la", "lo", "los", "las", "un", "una", "unos", "unas", "su", "sus", "mi", "mis", "tu", "tus", "nuestro", "nuestra", "nuestros", "nuestras", "este", "esta", "estos", "estas", "ese", "esa", "esos",
    "esas", "aquel", "aquella", "aquellos", "aquellas", "toda", "todo", "todas", "todos", "cualquier",
)
CESSATIONS = (
    "ceso en", "abandona", "abandono", "abandonaron", "rompio su alianza", "rompio la alianza", "rompio sus lazos", "renuncio a", "renuncio al", "dimitio de", "dimitio como", "fue expulsado de", "fue expulsada de",
    "fue destituido de", "fue destituida de", "fue abandonada por", "fue abandonado por", "se separo de", "perdio su puesto en", "salio del",
)
ADJUNCTS = ("sobre", "ante", "para", "por", "desde", "hasta", "tras", "durante", "contra", "segun", "mediante", "acerca", "respecto", "en")
CONJUNCTIONS = ("pero", "aunque", "sino", "mientras", "embargo")
CONNECTORS = ("por que", "lo que", "que", "si", "cuando", "donde", "adonde", "como", "quien", "quienes", "cual", "cuales", "cuanto", "cuanta", "cuantos", "cuantas")
ATTITUDES = (
    "consta", "considera", "consideraba", "cree", "creia", "creyo", "decia", "dice", "dijo", "imagina", "imaginaba", "parece", "parecia", "penso", "piensa", "pensaba", "recordaba", "recuerda", "sabe", "sabia", "supo",
    "sospecha", "sospechaba", "admite", "admiten", "admitio", "admitieron", "admitia", "admitian", "reconoce", "reconocen", "reconocio", "reconocieron", "reconocia", "reconocian",
    "niega", "niegan", "nego", "negaron", "negaba", "negaban",
)
ATTITUDE_STEMS, REPORT_STEMS = ("afirm", "declar", "asegur", "confirm", "verific", "acept"), ("afirm", "declar", "asegur", "coment", "relat", "inform", "mencion", "indic")
REPORTS = (
    "dice", "dicen", "dijo", "dijeron", "decia", "decian", "sostiene", "sostienen", "sostuvo", "sostuvieron", "sostenia", "sostenian", "cuenta", "cuentan", "conto", "contaron", "contaba", "contaban", "repite", "repiten",
    "repitio", "repitieron", "repetia", "repetian", "confiesa", "confiesan", "confeso", "confesaron", "confesaba", "confesaban", "escribe", "escriben", "escribio", "escribieron", "escribia", "escribian", "insiste",
    "insisten", "insistio", "insistieron", "insistia", "insistian",
)
# Two-word forms never match one token of the sentence, so only simple forms of verbs count.
ENDINGS = ("a", "an", "o", "aron", "aba", "aban")
REPORT_HOMOGRAPHS = ("cuenta", "cuentan", "relato")
# Fixed values, to EPISTEMIC_PATTERNS: what frames a sentence as something other than a statement.
FRAMES = {
    "FALSITY_CONTEXT": ("es falso que", "es mentira que", "no es cierto que", "no es verdad que", "nadie cree que", "nadie creia que", "afirmo falsamente", "aseguro falsamente", "falsamente", "se equivocaba al afirmar que", "mintio", "fingio", "se hacia pasar por", "desmiente", "desmienten", "nunca fue cierto que", "se falsifico"),
    "CONDITIONAL_CONTEXT": ("salvo que", "a menos que", "en caso de que", "siempre que", "de haber", "suponiendo que", "a no ser que", "solo si", "puestos a imaginar"),
    "COUNTERFACTUAL_CONTEXT": ("de haber",),
    "INTERROGATIVE_CONTEXT": ("pregunto", "nadie supo responder", "me pregunto si", "interrogatorio"),
    "FICTION_WITHIN_FICTION_CONTEXT": ("en la farsa", "en la obra", "en la representacion", "en la comedia", "en el drama", "en el serial", "en el relato", "en el cuento", "en la cancion", "en la balada", "en el poema", "en la novela", "en la leyenda", "en el mito", "segun la leyenda", "cuenta la leyenda", "los titiriteros representaron", "lo invento todo", "cuenta la balada", "sono que", "en el juego de cartas", "escenifican una version", "poema apocrifo", "en la pesadilla", "solo un arquetipo"),
    "DEONTIC_CONTEXT": ("no debe", "no deben", "no debia", "no debera", "no podra", "no podran", "queda prohibido", "esta prohibido", "se prohibe", "no se permite", "no permitas", "ordeno que", "prohibido", "se ruega", "no jures", "debera"),
    "DESIRE_CONTEXT": ("ojala", "quisiera que", "desearia que", "espera que", "esperaba que", "quiere que", "queria que", "desea que", "deseaba que", "anhela que", "suenan con", "le gustaria", "pluguiera", "quisiera"),
}
HINTS = [
    ("RUMORED", ("se rumorea", "corre el rumor de que", "dicen que", "se dice que", "segun cuentan", "supuestamente", "al parecer")),
    ("HYPOTHETICAL", ("quiza", "quizas", "tal vez", "podria", "si acaso", "cabe suponer que", "barajan la posibilidad de que", "es probable que", "con la hipotesis de que", "podria ser que", "se sospecha que", "nada impide pensar que", "supongamos", "todo apunta a que")),
    ("INTENDED", ("planea", "pretende", "tiene intencion de", "jurara")),
]
RUMOR_PATTERNS = (r"dicen (?:el|la|los|las) (?:\w+ ){0,6}que", r"llego a oidos (?:de|del|de la|de los|de las) (?:\w+ ){0,3}que", r"corre por (?:el|la|los|las) (?:\w+ ){0,3}que")
WHILE_NOT = r"mientras (?:\w+ ){0,4}no"


def one_of(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


def inflected(stems: tuple[str, ...]) -> list[str]:
    return [s + e for s in stems for e in ENDINGS]


def plain(c: Column) -> Column:
    """Tokens between single spaces, with | for a comma, a colon or a line's end."""
    bounded = F.regexp_replace(T.strip_accents(F.lower(c)), r"[,;:\n\r]+", " | ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bounded, r"[^\p{L}\p{N}_|]+", " ")), F.lit(" "))


def has(c: Column, pattern: str) -> Column:
    """Whether the pattern stands in the string as whole tokens."""
    return c.rlike(f"(?<= ){pattern}(?= )")


MARK = one_of(*NEGATIONS)
ATTITUDE = one_of(*ATTITUDES, *inflected(ATTITUDE_STEMS))
LONE_CESSATION = one_of(
    f"{one_of(*STOP_FORMS)} de(?= {one_of(*RELATIONAL_VERBS)} )",
    f"{one_of(*[f for f in STOP_FORMS if 'ces' not in f])} atras(?= (?:{one_of(*DETERMINERS)} )*{one_of(*RELATIONAL_NOUNS)} )", *CESSATIONS,
)
CESSATION = one_of("ya no", LONE_CESSATION)


def clause(before: Column) -> Column:
    """What stands before the focus in its clause: behind the last conjunction or boundary."""
    return F.regexp_replace(before, rf"^.* (?:{one_of(*CONJUNCTIONS)}|\|)(?= )", "")


def last_tokens(before: Column, n: int) -> Column:
    """The last n tokens, and the boundaries between them."""
    return F.coalesce(F.nullif(F.regexp_extract(before, rf"((?: \|)*(?: (?!\|)\S+(?: \|)*){{0,{n}}} )$", 1), F.lit("")), F.lit(" "))


def negation(head: Column, flat: Column, marked: Column, focus: Column) -> Column:
    """The kind of negation of what is said at the focus. head: the tokens that count in front of it; flat: these and all from
    the focus on; marked: the same with @ at the focus; focus: from the focus on, with boundaries.

    In this order: the negation of an attitude (no cree que), an exceptive clause (sin que) that holds the focus or may, a
    negated cessation, two negations, not yet, a cessation, never, a simple one. SCOPE_AMBIGUOUS asks for a review and
    never negates; '' is no negation.
    """
    attitude = marked.rlike(rf"^[^@]* {MARK} (?:@ )?{ATTITUDE} (?:@ )?{one_of(*CONNECTORS)} ")
    exceptive = has(head, "sin que")
    stop = one_of(*ADJUNCTS, *CONJUNCTIONS)
    rest = F.regexp_extract(head, r"^.*?(?<= )sin que( .*)$", 1)
    outside = has(rest, stop) | focus.rlike(rf"^ {stop} ") | (focus.startswith(" |") & (F.trim(rest) != ""))
    marks = F.regexp_count(head, F.lit(r"(?<= )(?:no(?! poc[oa]s )|nunca|jamas)(?= )"))
    undone = flat.rlike(rf"(?<= ){MARK} (?:\S+ ){{0,{CESSATION_WINDOW - 1}}}{CESSATION}(?= )")
    double = marks + F.regexp_count(flat, F.lit(f"(?<= ){LONE_CESSATION}(?= )")) >= 2
    return first_that(
        (attitude, "SCOPE_AMBIGUOUS"), (exceptive & outside, "SCOPE_AMBIGUOUS"), (exceptive, "SIMPLE"), (undone, "SCOPE_AMBIGUOUS"), (double, "SCOPE_AMBIGUOUS"), (has(flat, one_of(*NOT_YET)), "NOT_YET"),
        (has(flat, CESSATION), "CESSATION"), (has(head, one_of(*NEVER)), "NEVER"), (marks > 0, "SIMPLE"), (has(head, "(?:ni|tampoco)"), "SIMPLE"), otherwise="",
    )


def readings(rows: DataFrame, sentence: str, focus_at: Column) -> DataFrame:
    """rows with what their sentence says of the thing at focus_at (its place in the sentence from 0): negated, kind, hint
    (ASSERTED, RUMORED, HYPOTHETICAL, INTENDED, UNKNOWN), factivity, action and context (sorted codes).

    negated and kind look at WINDOW tokens in front of the focus, within its clause; the factivity, more careful, at all of
    the sentence in front of it. Strings and flags are columns of their own, so none is made twice. A null sentence has
    nulls and states nothing.
    """
    unbound = lambda c: F.regexp_replace(c, r" \|(?= )", "")
    c = F.col
    rows = rows.withColumns({"__raw": F.substring(sentence, F.lit(1), focus_at), "__rest": F.substring(sentence, focus_at + 1, F.length(sentence))})
    rows = rows.withColumns({"__before": plain(c("__raw")), "__tail": plain(c("__rest"))})
    # A boundary right before the focus belongs to what follows it.
    bound = c("__before").endswith(" | ")
    rows = rows.withColumns({
        "__tail": F.when(bound, F.concat(F.lit(" |"), c("__tail"))).otherwise(c("__tail")),
        "__before": F.when(bound, F.concat(F.rtrim(F.regexp_replace("__before", r"(?: \|)+ $", "")), F.lit(" "))).otherwise(c("__before")),
    })
    rows = rows.withColumns({"__wide": unbound(c("__before")), "__near": unbound(clause(last_tokens(c("__before"), WINDOW))), "__after": unbound(c("__tail"))})
    both = lambda head, at="": F.concat(F.rtrim(c(head)), F.lit(at), c("__after"))
    rows = rows.withColumns({"__every": both("__wide"), "__flat": both("__near"), "__at": both("__near", " @"), "__at_wide": both("__wide", " @")})
    rows = rows.withColumns({"kind": negation(c("__near"), c("__flat"), c("__at"), c("__tail")), "__kind": negation(c("__wide"), c("__every"), c("__at_wide"), c("__tail"))})
    every, sure = c("__every"), lambda k: (c(k) != "") & (c(k) != "SCOPE_AMBIGUOUS")
    verbs = one_of(*[v for v in (*REPORTS, *inflected(REPORT_STEMS)) if v not in REPORT_HOMOGRAPHS])
    frames = {code: has(every, one_of(*phrases)) for code, phrases in FRAMES.items()}
    if_ = F.lower("__raw").rlike(r"(?<![\p{L}\p{M}\p{N}_])si(?![\p{L}\p{M}\p{N}_])")
    frames["CONDITIONAL_CONTEXT"] = frames["CONDITIONAL_CONTEXT"] | has(every, WHILE_NOT) | if_
    frames["INTERROGATIVE_CONTEXT"] = frames["INTERROGATIVE_CONTEXT"] | c(sentence).rlike("[¿?]")
    frames["REVIEW_NEGATION_SCOPE"] = (c("__kind") == "SCOPE_AMBIGUOUS") | (c("kind") == "SCOPE_AMBIGUOUS") | has(c("__wide"), f"{MARK} {ATTITUDE}")
    frames["REPORTED_SPEECH_CONTEXT"] = has(every, f"(?:{verbs}|(?<! {one_of(*DETERMINERS)} ){one_of(*REPORT_HOMOGRAPHS)}) que")
    rows = rows.withColumns({f"__{code}": F.coalesce(found, F.lit(False)) for code, found in frames.items()})
    is_ = {code: c(f"__{code}") for code in frames}
    said = first_that(*[(has(every, one_of(*phrases)), hint) for hint, phrases in HINTS], (has(every, one_of(*RUMOR_PATTERNS)), "RUMORED"), (is_["REPORTED_SPEECH_CONTEXT"], "RUMORED"), (is_["CONDITIONAL_CONTEXT"], "HYPOTHETICAL"), otherwise="ASSERTED")
    rows = rows.withColumn("__said", said)
    unstated = is_["FALSITY_CONTEXT"] | is_["INTERROGATIVE_CONTEXT"] | is_["FICTION_WITHIN_FICTION_CONTEXT"] | ((is_["DEONTIC_CONTEXT"] | is_["DESIRE_CONTEXT"]) & (c("__said") == "ASSERTED"))
    rows = rows.withColumns({"negated": sure("kind"), "hint": F.when(unstated, "UNKNOWN").otherwise(c("__said"))})
    rows = rows.withColumn("factivity", first_that(
        (is_["REVIEW_NEGATION_SCOPE"], "UNKNOWN"), (is_["INTERROGATIVE_CONTEXT"], "QUESTION"), (is_["COUNTERFACTUAL_CONTEXT"], "COUNTERFACTUAL"), (is_["FALSITY_CONTEXT"], "REPORTED_FALSEHOOD"),
        (is_["FICTION_WITHIN_FICTION_CONTEXT"], "FICTION_WITHIN_FICTION"), (is_["DESIRE_CONTEXT"], "DESIRE"), (is_["DEONTIC_CONTEXT"], "COMMAND"), (is_["CONDITIONAL_CONTEXT"], "CONDITIONAL"),
        (c("hint") == "HYPOTHETICAL", "HYPOTHETICAL"), (c("hint") == "RUMORED", "RUMOR"), (sure("__kind"), "NEGATED_FACT"), otherwise="ASSERTED_FACT",
    ))
    f = c("factivity")
    action = first_that((f == "UNKNOWN", "REVIEW_SCOPE"), (f == "RUMOR", "EMIT_EPISTEMIC_PROPOSAL"), (f == "NEGATED_FACT", "EMIT_NEGATED_WORLD_CLAIM"), (f == "ASSERTED_FACT", "EMIT_WORLD_CLAIM"), otherwise="EMIT_DIAGNOSTIC")
    rows = rows.withColumns({"action": action, "context": codes(*[(found, code) for code, found in is_.items()])})
    return rows.drop(*[x for x in rows.columns if x.startswith("__") and x != sentence])
