"""The default rules of relations, as rows for rule_claims: phrases that name a predicate, stated or made from paradigms."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

# Fixed values, to the end of RULES: verb forms, offices, phrases, types, directions and confidences.
STOP_FORMS = (
    "deja", "dejan", "dejo", "dejaron", "dejaba", "dejaban", "dejara", "dejaran", "dejase", "dejasen", "ha dejado", "han dejado", "habia dejado", "habian dejado", "esta dejando", "estan dejando",
    "cesa", "cesan", "ceso", "cesaron", "cesaba", "cesaban", "ha cesado", "han cesado",
)
OFFICES = ("la presidencia", "la direccion", "la jefatura", "el mando", "el liderazgo", "la capitania", "la regencia", "la magistratura")
OFFICE_PHRASES = ("en {} de", "fue destituido de {} de", "fue destituida de {} de", "ha cedido {} de", "cedio {} de", "asumio {} de", "ostenta {} de", "renuncio a {} de")
ADVERBS = ("aun", "ya", "todavia", "siempre")
LED = ("es dirigida por", "es dirigido por", "esta dirigida por", "esta dirigido por", "fue dirigida por", "fue dirigido por")
NOUN_MARKS = ("el", "la", "los", "las", "un", "una", "su", "sus", "este", "ese", "aquel", "del", "al", "de", "tras")


def stopped(*infinitives: str) -> list[str]:
    return [f"{form} de {verb}" for verb, form in product(infinitives, STOP_FORMS)]


def with_adverbs(*phrases: str) -> list[str]:
    """Each phrase, and with each adverb behind its first word."""
    return [" ".join([first, *([adverb] if adverb else []), rest]) for first, rest in (p.split(" ", 1) for p in phrases) for adverb in ("", *ADVERBS)]


ALONG, AGAINST, NONE = "SUBJECT_TO_OBJECT", "OBJECT_TO_SUBJECT", ()
RULES = [
    ("MEMBER_OF", ALONG, 0.75, False, ["es miembro de", "son miembros de", "pertenece a", "pertenecen a", "milita en", "forma parte de", "forma parte del", "pertenezca a", "pertenezca al", "pertenece al", "pertenecia a", "pertenecia al", "pertenecio a", "pertenecio al", *stopped("pertenecer a", "pertenecer al"), "haya abandonado", "ceso en su condicion de miembro de"], ["Faction"], NONE),
    ("MEMBER_OF", ALONG, 0.75, False, ["abandona", "abandono", "abandonaron", "abandonase", "abandonaba"], ["Faction"], NOUN_MARKS),
    ("LEADS", ALONG, 0.72, False, ["lidera", "es lider de", "capitanea", "comanda", "dirige", *stopped("liderar", "dirigir", "encabezar", "presidir", "capitanear", "comandar")], NONE, NONE),
    ("LEADS", ALONG, 0.50, False, ["dirigio", "ha dirigido", "han dirigido", "lidero", "encabezo", "presidio", *(p.format(o) for p, o in product(OFFICE_PHRASES, OFFICES))], NONE, NONE),
    ("LEADS", AGAINST, 0.72, False, [*with_adverbs(*LED), *stopped("estar dirigida por", "estar dirigido por")], NONE, NONE),
    ("RULES", ALONG, 0.68, False, ["gobierna", "reina en", "gobierna en"], NONE, NONE),
    ("LIVES_IN", ALONG, 0.72, False, ["vive en", "viven en", "reside en", "residen en", "habita en"], ["Location"], NONE),
    ("LOCATED_IN", ALONG, 0.7, False, ["se encuentra en", "esta situado en", "esta ubicado en", "se halla en", "este en"], ["Location"], NONE),
    ("PARENT_OF", ALONG, 0.75, False, ["es padre de", "es madre de"], NONE, NONE),
    ("CHILD_OF", ALONG, 0.75, False, ["es hijo de", "es hija de"], NONE, NONE),
    ("SIBLING_OF", ALONG, 0.72, True, ["es hermano de", "es hermana de"], NONE, NONE),
    ("ALLY_OF", ALONG, 0.7, True, ["es aliado de", "es aliada de", "se alia con", "es aliado del", "es aliada del", "sea aliada de", "sea aliado de"], NONE, NONE),
    ("ENEMY_OF", ALONG, 0.68, True, ["es enemigo de", "es enemiga de", "se enfrenta a", "es rival de"], NONE, NONE),
    ("SERVES", ALONG, 0.68, False, ["sirve a", "jura lealtad a", "obedece a", *stopped("servir a", "servir al")], NONE, NONE),
    ("OWNS", ALONG, 0.62, False, ["posee", "empuna", "porta", "estuvo en manos del", "estuvo en manos de", "es propiedad de", "es propiedad del", "era propiedad de", "era propiedad del", "del patrimonio de", "del patrimonio del", "propiedad del"], NONE, NONE),
    ("OWNS", ALONG, 0.50, False, ["bajo el control del"], NONE, NONE),
    ("MEMBER_OF", AGAINST, 0.7, False, ["fue abandonada por", "fue abandonado por"], NONE, NONE),
    ("KILLED", ALONG, 0.75, False, ["mato a", "asesino a", "dio muerte a"], NONE, NONE),
    ("FOUNDED", ALONG, 0.7, False, ["fundo", "fundo la", "fundo el"], NONE, NONE),
]


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(f"{k:02d}-{p}", p, d, c, s, phrases, [], list(types), list(blocked)) for k, (p, d, c, s, phrases, types, blocked) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_id string, predicate string, direction string, confidence double, symmetric boolean, phrases array<string>, subject_types array<string>, object_types array<string>, blocked_before array<string>")
