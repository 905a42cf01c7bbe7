"""Personal data by weak supervision (native).

Wide patterns propose candidate spans. Four labelers vote on each (yes, no, abstain): the strict pattern with its check
digits, a gazetteer, the words before the span, and its shape. Expectation-maximisation over the counts of vote patterns,
a table of fixed size, estimates each labeler's reliability and each candidate's probability without any labelled data.
With these probabilities as soft labels a naive Bayes span classifier is trained on the candidates' features, again from
counts. Spans that pass the base rules always stay; the classifier decides on all other candidates.

Everything that touches texts is one projection of built-in functions: no shuffle, and patterns that are linear in the
text. The driver sees counts of votes and features only.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import staged, table, whole

KINDS = ["email", "ip", "card", "phone", "secret"]

# The wide patterns of candidates. Those of the first four kinds find what the base rules' patterns find;
# \G and the look-behind only keep a run of characters from being tried at each of its places.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
HIDDEN_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+(.-])(?<!\+[0-9] )\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"""(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{2,}+["']? {0,3}[:=] {0,3}["']?[A-Za-z0-9+/_.=-]{8,}"""

# Gazetteers and context words.
DOMAIN_ENDS = "com|org|net|edu|gov|mil|int|io|info|biz|dev|app|co|me|de|fr|es|it|nl|be|pt|pl|se|dk|no|fi|eu|uk|ie|ch|at|us|ca|br|mx|ar|au|nz|in|jp|kr|cn|ru"
SECRET_NAMES = "password|passwd|pwd|passphrase|token|secret|api_?key|access_?key|private_?key|signing_?key|session_?id|auth|bearer|credential|cookie"
CONTEXT = {
    "email": "mail|contact|correo|courriel|kontakt|write to",
    "ip": "ip|server|host|address|adresse|direcci",
    "card": "card|visa|master|amex|credit|carte|karte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|rufen|llame|appel",
    "secret": "login|key|credential|config|export|set ",
}
LABELERS = ("strict", "gazetteer", "context", "shape")
YES, NO, ABSTAIN = 1, 0, 2


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    r = F.reverse(d)
    one = lambda i: F.substring(r, i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def small_parts(s: Column) -> Column:
    """Whether each part of a dotted number is at most 255."""
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.forall(F.split(s, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.right(bare(x), F.lit(3)).cast("int") <= 255))


def base_rule(kind: str, s: Column) -> Column:
    d = digits(s)
    return {
        "email": F.lit(True),
        "ip": small_parts(s),
        "card": F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False),
        "phone": F.length(d).between(9, 15),
    }[kind]


def vote(yes: Column, otherwise: int) -> Column:
    return F.when(yes, YES).otherwise(otherwise)


def votes(kind: str, s: Column, before: Column, base: Column) -> Column:
    """What the labelers say of a candidate, in the order of LABELERS."""
    d = digits(s)
    value = F.regexp_extract(s, r"[:=] {0,3}[\"']?(.*)$", 1)
    gazetteer = {
        "email": vote(s.rlike(rf"(?i)(\.|dot[\])] ?)({DOMAIN_ENDS})$"), ABSTAIN),
        "ip": vote(~s.rlike(r"^(0|10|127|255)\."), NO),
        "card": vote(d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), NO),
        "phone": vote(s.rlike(r"^(\+(1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-8])|\(?[2-9])"), ABSTAIN),
        "secret": vote(s.rlike(f"(?i)^[A-Za-z0-9_]*?({SECRET_NAMES})"), NO),
    }[kind]
    shape = {
        "email": vote(s.rlike("^[A-Za-z0-9].{2,254}$"), NO),
        "ip": vote(F.length(s) >= 7, NO),
        "card": vote(s.rlike("^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$") & ~before.rlike("[A-Za-z0-9]$"), NO),
        "phone": vote(F.length(d).between(10, 13), NO),
        "secret": vote((F.length(value) >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]"), NO),
    }[kind]
    strict = vote(base, NO) if kind != "secret" else vote(value.rlike("^[0-9a-f]{12,}$"), ABSTAIN)
    return F.array(strict, gazetteer, vote(before.rlike(f"(?i)({CONTEXT[kind]})"), ABSTAIN), shape)


def found(text: Column, pattern: str, there: Column, kind: str, base: bool, wanted) -> Column:
    """Candidates of one pattern: an array of (start, rank of kind, end, base, votes, features).

    The pieces between the matches give the places. Matches that are neither base spans nor `wanted` are passed over.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int,base:boolean,votes:array<int>,features:array<string>>>")
    parts = F.when(there, F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")))
    parts = F.coalesce(parts, F.array().cast("array<struct<gap:string,hit:string>>"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        is_base = base_rule(kind, part["hit"]) if base else F.lit(False)
        before = F.right(part["gap"], F.lit(24))
        says = votes(kind, part["hit"], before, is_base)
        # Of an assignment only the value is personal.
        begin = end - F.length(F.regexp_extract(part["hit"], r"[:=] {0,3}[\"']?(.*)$", 1)) if kind == "secret" else start
        features = F.concat(
            F.transform(says, lambda v, i: F.concat(F.lit(f"{kind}/"), i.cast("string"), F.lit("="), v.cast("string"))),
            F.array(
                F.concat(F.lit(f"{kind}/length="), F.least(F.floor(F.length(part["hit"]) / 4), F.lit(10)).cast("string")),
                F.concat(F.lit(f"{kind}/before="), F.when(before == "", "start").when(before.rlike("[A-Za-z]$"), "letter").when(before.rlike("[ \n]$"), "space").otherwise("other")),
            ),
        )
        one = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), is_base.alias("base"), says.alias("votes"), features.alias("features"))
        take = part["hit"].isNotNull() & (is_base | wanted(part["hit"]))
        return F.struct(end.alias("at"), F.when(take, F.concat(state["spans"], F.array(one))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def candidates(text: Column) -> Column:
    """All candidates of a text, by place and kind."""
    has = lambda x: F.contains(text, F.lit(x))
    never, always = (lambda s: F.lit(False)), (lambda s: F.lit(True))
    numbers = text.rlike("[0-9]")
    return F.array_sort(F.concat(
        found(text, EMAIL, has("@"), "email", True, never),
        found(text, IP, numbers & has("."), "ip", True, never),
        found(text, CARD, numbers, "card", True, lambda s: F.length(digits(s)).between(12, 19)),
        found(text, PHONE, has("+"), "phone", True, never),
        found(text, HIDDEN_EMAIL, text.rlike(r"[\[(]at[\])]"), "email", False, always),
        found(text, LOCAL_PHONE, text.rlike("[0-9]{3}[ .-][0-9]{4}"), "phone", False, always),
        found(text, SECRET, has("=") | has(":"), "secret", False, always),
    ))


def reliabilities(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[tuple, float], dict]:
    """The probability that a candidate with (kind, votes) is personal data, and the labelers' reliabilities.

    counts: candidates by (kind, votes). Labelers vote independently given the truth; at first a yes or no is held to be
    right four times out of five.
    """
    says = [[{YES: 0.1, NO: 0.4, ABSTAIN: 0.5}, {YES: 0.4, NO: 0.1, ABSTAIN: 0.5}] for _ in LABELERS]
    prior = defaultdict(lambda: 0.5)
    chance: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, votes_ in counts:
            log = [math.log(1 - prior[kind]), math.log(prior[kind])]
            for k, v in enumerate(votes_):
                for y in (0, 1):
                    log[y] += math.log(says[k][y][v])
            chance[kind, votes_] = 1 / (1 + math.exp(min(700, max(-700, log[0] - log[1]))))
        total, true = defaultdict(float), defaultdict(float)
        seen = [[defaultdict(float), defaultdict(float)] for _ in LABELERS]
        for (kind, votes_), n in counts.items():
            p = chance[kind, votes_]
            total[kind] += n
            true[kind] += n * p
            for k, v in enumerate(votes_):
                seen[k][0][v] += n * (1 - p)
                seen[k][1][v] += n * p
        for kind in total:
            prior[kind] = (true[kind] + 1) / (total[kind] + 2)
        says = [[{v: (s[v] + 1) / (sum(s.values()) + 3) for v in (YES, NO, ABSTAIN)} for s in pair] for pair in seen]
    return chance, {"labelers": dict(zip(LABELERS, says)), "prior": dict(prior)}


def fit(found_: DataFrame) -> dict[str, float]:
    """Weights (log odds) of the features, "kind" for a kind alone, from all candidates in the column `candidates`."""
    one = found_.select(F.explode("candidates").alias("c")).select("c.rank", "c.votes", F.explode("c.features").alias("feature"))
    rows = one.groupBy("rank", "votes", "feature").count().collect()  # kinds x votes x features: at most some thousand rows
    first = {}  # each candidate has one feature of the first labeler, so those counts are counts of candidates
    for r in rows:
        if "/0=" in r["feature"]:
            first[KINDS[r["rank"]], tuple(r["votes"])] = r["count"]
    chance, _ = reliabilities(first)
    yes, no = defaultdict(float), defaultdict(float)
    for r in rows:
        kind = KINDS[r["rank"]]
        p = chance[kind, tuple(r["votes"])]
        for name in (r["feature"], kind) if "/0=" in r["feature"] else (r["feature"],):
            yes[name] += p * r["count"]
            no[name] += (1 - p) * r["count"]
    weights = {}
    for name in yes:
        kind = name.split("/")[0]
        if name == kind:
            weights[name] = math.log((yes[name] + 1) / (no[name] + 1))
        else:
            weights[name] = math.log((yes[name] + 1) / (yes[kind] + 8)) - math.log((no[name] + 1) / (no[kind] + 8))
    return weights


def spans(found_: Column, weights: dict[str, float]) -> Column:
    """The base spans, and the other candidates that the classifier takes and that overlap none of them."""
    table_ = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    weight = lambda name: F.coalesce(F.try_element_at(table_, name), F.lit(0.0))
    kinds = F.array(*map(F.lit, KINDS))
    score = lambda c: F.aggregate(c["features"], weight(F.get(kinds, c["rank"])), lambda s, f: s + weight(f))
    base = F.filter(found_, lambda c: c["base"])
    clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return F.filter(found_, lambda c: c["base"] | ((score(c) > 0) & clear(c)))


def listed(spans_: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda c: F.concat_ws(":", F.get(kinds, c["rank"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, base (array of base spans) and spans (all spans) of every row of documents (doc_id, text).

    A span has start and end (code points, end exclusive), rank (place of its kind in KINDS) and base. Null and empty
    texts have none. Rows are judged one by one, so repeated rows and null doc_ids come out as they went in; other columns
    are ignored. No documents, no rows.
    """
    rows = staged(documents.select("doc_id", candidates(whole("text")).alias("candidates")), "candidates")
    weights = fit(rows)
    return rows.select("doc_id", F.filter("candidates", lambda c: c["base"]).alias("base"), spans(F.col("candidates"), weights).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """documents with each span of the text replaced by its kind in brackets. Null texts stay null; other columns stay.

    Of overlapping spans the one that starts first counts, and the rest of the others goes with it.
    """
    text = whole("text")
    weights = fit(documents.select(candidates(text).alias("candidates")))
    rows = documents.withColumn("__spans", spans(candidates(text), weights))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.get(marks, s["rank"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, out).otherwise(state["out"]).alias("out"))

    done = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn("text", F.when(F.size("__spans") > 0, done).otherwise(F.col("text"))).drop("__spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda c: c["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS[:4]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
