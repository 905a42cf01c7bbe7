"""Temporal and epistemic classes of a text by the cues it holds, as one expression each."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.scores import first_that

# The cues of each class, folded, by precedence.
TEMPORAL = [
    ("ENDED", "ya no|dejo de|dejaron de|termino|terminaron|concluyo|concluyeron|rompio|rompieron|abandono|abandonaron|renuncio|renunciaron|disolvio|disolvieron|caduco|expiro|antiguo|antigua|antiguos|antiguas|otrora|ex|difunto|difunta|fallecido|fallecida|extinto|extinta"),
    ("NOT_YET", "todavia no|aun no"),
    ("FUTURE", "sera|seran|planea|planean|planeado|planeada|preve|preven|pretende|pretenden|promete|prometen|prometio|prometieron|futuro|futura|futuros|futuras|proximamente|se espera|espera que|por venir|venidero|venidera|nombrara|nombraran|heredara|heredaran|competira|competiran"),
    ("ONGOING", "desde|sigue|siguen|continua|continuan|actualmente|todavia|aun|en la actualidad|hoy en dia|a dia de hoy|sin interrupcion|ininterrumpidamente"),
    ("PAST", "fue|fueron|era|eran|en su dia|tras|despues de|antano|hace anos|hace siglos|hace tiempo|mas tarde|tiempo despues|en el pasado|una vez|antiguamente"),
    ("POTENTIAL", "podria|podrian|quiza|quizas|tal vez|puede que|es posible que|es probable|posiblemente|acaso|si acaso|en caso de|de ser asi|hipoteticamente"),
    ("RECURRING", "todo|toda|todos|todas|cada|siempre|cada vez|habitualmente|de costumbre|por norma|suele|suelen|acostumbra|acostumbran|periodicamente|anualmente|cada ano"),
    ("DATED", "[0-9]{4}"),
    ("PRESENT", "es|son|esta|estan|pertenece|pertenecen|reside|residen|vive|viven|habita|habitan|posee|poseen|ostenta|ostentan|domina|dominan|lidera|lideran|encabeza|encabezan|preside|presiden|custodia|custodian|guarda|guardan|protege|protegen"),
]
EPISTEMIC = [
    ("RUMORED", "rumor", "se rumorea|se dice que|dicen que|segun rumores|al parecer|supuestamente|se comenta que|corre el rumor"),
    ("RUMORED", "indirect", "segun|cuentan que|se sabe por|de acuerdo con"),
    ("RUMORED", "belief", "cree que|creen que|opina que|piensa que|considera que|sospecha que"),
    ("HYPOTHETICAL", "contradiction", "se contradice|pero niega|afirman lo contrario|afirma lo contrario|lo contrario|version contraria|en disputa|version discrepante|fuentes discrepan|otros niegan"),
    ("HYPOTHETICAL", "doubt", "quiza|quizas|tal vez|acaso"),
    ("HYPOTHETICAL", "possibility", "puede que|podria|es posible|posiblemente"),
    ("HYPOTHETICAL", "hypothesis", "si|en caso de|suponiendo|hipoteticamente|de ser cierto"),
    ("INTENDED", "intention", "planea|pretende|tiene intencion|promete|proyecta|hara"),
]


def holds(folded: Column, cues: str) -> Column:
    """Whether the folded text has one of the cues as whole words."""
    return folded.rlike(f"(^| )({cues})( |$)")


def temporal_state(c: Column) -> Column:
    """The first class by precedence whose cues the text holds; UNKNOWN if none."""
    return T.bound(T.fold(c), lambda folded: first_that(*[(holds(folded, cues), state) for state, cues in TEMPORAL], otherwise="UNKNOWN"))


def epistemic_state(c: Column) -> tuple[Column, Column]:
    """(status, nuance); without a cue a text asserts."""
    first = lambda k, otherwise: T.bound(T.fold(c), lambda folded: first_that(*[(holds(folded, e[2]), e[k]) for e in EPISTEMIC], otherwise=otherwise))
    return first(0, "ASSERTED"), first(1, "assertion")
