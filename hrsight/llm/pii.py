"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidates are matches of one pattern for each kind. Base kinds (email, ip,
card, phone) have exact definitions; their valid matches are always reported.
Labelers vote +1, -1 or 0 on every candidate: form checks, gazetteers (domain
endings, card issuers, key prefixes, given names), context words before it,
what stands next to it, and variety of its characters. Expectation-maximisation
over the table of vote patterns estimates each labeler's reliability; its
posteriors are the soft labels from which the final classifier (naive Bayes over
votes, kind and shape) is trained. Candidates of the other kinds that it accepts
are added, unless they overlap a base span.

All of it is built-in SQL functions. Candidates stay with their document's row,
so nothing but vote patterns is shuffled: at most 3^6 of them per kind.

Patterns are written so that matching is linear in the text: possessive runs,
and a look-behind instead of retries from inside a run. Offsets count code
points; the end is exclusive.

Defined results: null and empty texts have no spans; every row is returned,
repeated rows repeatedly, whatever its id; other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrsight.llm.tasks import saved

#: Kinds in the order of the report; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "local_phone", "id_number", "iban", "spelled_email", "secret", "name"]
BASE = 4

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?:\([0-9]{3}\) ?|(?<![0-9+().-])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "id_number": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
              r"|(?:password|passwd|pwd|secret|token|api_key|apikey) ?[=:] ?\x22?[A-Za-z0-9+/_-]{8,}+\x22?)",
    "name": r"(?<![A-Za-z0-9])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?",
}
#: A text without this substring pattern has no candidate of the kind.
NEEDS = {"email": "@", "phone": "+", "spelled_email": "at]|at)", "secret": "AKIA|=|:", "id_number": "-"}

# Gazetteers and cue words of the labelers (own choice).
ENDINGS = "com org net edu gov info io de fr es eu uk us ch at nl it ca au".split()
GIVEN_NAMES = ("anna carlos claire emma hans jan jean john jose julia klaus laura lucia maria marie martin mary michael "
               "paul peter pierre robert sofia sophie thomas").split()
CUES = ("mail contact reach phone call tel fax mobile card visa account iban bank name password token key login ssn social "
        "address ip host server telefon anruf konto karte kontakt appel carte compte correo llamar tarjeta cuenta").split()
DENIALS = "version isbn issn order invoice page chapter section license licence volume fig figure table no nr item sku".split()
LABELERS = ["form", "gazetteer", "cue", "denial", "edge", "variety"]


def spans_of(found: Column, gaps: Column, kind: int, context: int) -> Column:
    """Array of (start, kind, stop, match, text before, text after) from matches and what lies between them.

    Offsets run on over (gap, match) pairs, in blocks, so that appending stays cheap.
    """
    size = 64
    pairs = F.transform(found, lambda m, i: F.struct(
        F.length(F.get(gaps, i)).alias("gap"), m.alias("m"), F.lower(F.right(F.get(gaps, i), F.lit(context))).alias("l"),
        F.left(F.get(gaps, i + 1), F.lit(1)).alias("r")))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,m:string,l:string,r:string>>")

    def one(acc, x):
        at = acc["pos"] + x["gap"]
        stop = at + F.length(x["m"])
        item = F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["m"].alias("m"),
                        x["l"].alias("l"), x["r"].alias("r"))
        return F.struct(stop.alias("pos"), F.concat(acc["out"], F.array(item)).alias("out"))

    def many(acc, b):
        inner = F.aggregate(F.slice(pairs, b * size + 1, F.lit(size)), F.struct(acc["pos"].alias("pos"), empty.alias("out")), one)
        return F.transform(F.array(inner), lambda i: F.struct(
            i["pos"].alias("pos"), F.concat(acc["out"], i["out"]).alias("out")))[0]

    turns = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int"))
    run = F.aggregate(turns, F.struct(F.lit(0).alias("pos"), empty.alias("out")), many)
    return F.when(F.size(found) > 0, run["out"]).otherwise(empty)


def candidates(docs: DataFrame, id_col: str, text_col: str, context: int = 40) -> DataFrame:
    """Per input row: id and `c`, its candidates of all kinds."""
    none = F.array().cast("array<string>")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def found(kind):
        hits = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        if kind not in NEEDS:
            return hits
        return F.when(reduce(lambda a, b: a | b, [F.contains("text", F.lit(x)) for x in NEEDS[kind].split("|")]), hits).otherwise(none)

    src = src.select("id", "text", *[found(k).alias(k) for k in KINDS])
    src = src.select("id", *KINDS, *[F.when(F.size(k) > 0, F.split("text", PATTERNS[k], -1)).otherwise(none).alias(f"{k}_gaps") for k in KINDS])
    return src.select("id", F.concat(*[spans_of(F.col(k), F.col(f"{k}_gaps"), i, context) for i, k in enumerate(KINDS)]).alias("c"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits(m))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(
        i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*[F.lit(2 * x - 9 * (x > 4)) for x in range(10)]), F.substring(d, i, F.lit(1)).cast("int"))))
    return total % 10 == 0


def valid(x: Column) -> Column:
    """The exact definitions of the base kinds; other kinds are valid by their pattern."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.length(digits(x["m"]))
    return (F.when(x["kind"] == KINDS.index("ip"), x["m"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(x["kind"] == KINDS.index("card"), luhn(x["m"]))
            .when(x["kind"] == KINDS.index("phone"), (n >= 10) & (n <= 15)).otherwise(F.lit(True)))


def any_word(text: Column, listed) -> Column:
    return text.rlike(r"(?:^|[^a-z])(?:" + "|".join(listed) + ")(?:$|[^a-z])")


def votes(x: Column) -> dict[str, Column]:
    """+1, -1 or 0 of each labeler on a candidate."""
    kind = lambda *names: x["kind"].isin(*[KINDS.index(k) for k in names])
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    tail = F.lower(F.regexp_extract(x["m"], "([A-Za-z]+)[^A-Za-z]*$", 1))
    d = digits(x["m"])
    listed = (F.when(kind("email", "spelled_email"), vote(tail.isin(*ENDINGS), F.length(tail) < 2))
              .when(kind("card"), vote(d.rlike("^[3-6]"), F.lit(True)))
              .when(kind("ip"), vote(~x["m"].rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\."), F.lit(True)))
              .when(kind("phone"), vote(d.rlike("^[1-9]"), F.lit(True)))
              .when(kind("local_phone"), vote(d.rlike("^[2-9]"), F.lit(True)))
              .when(kind("id_number"), vote(~d.rlike("^(?:000|666|9)"), F.lit(True)))
              .when(kind("secret"), vote(x["m"].rlike("^AKIA|[0-9]"), F.lit(True)))
              .when(kind("name"), vote(any_word(F.lower(x["m"]), GIVEN_NAMES), F.lit(False))).otherwise(0))
    shown = F.when(kind("name"), F.lit(9)).otherwise(F.size(F.array_distinct(F.split(F.lower(x["m"]), ""))))
    return {
        "form": F.when(valid(x), 1).otherwise(-1),
        "gazetteer": listed,
        "cue": F.when(any_word(x["l"], CUES) | kind("secret") & x["m"].rlike("^[a-z]"), 1).otherwise(0),
        "denial": F.when(x["l"].rlike(r"(?:^|[^a-z])(?:" + "|".join(DENIALS) + r")[ .:#]*$"), -1).otherwise(0),
        "edge": F.when(F.right(x["l"], F.lit(1)).rlike("[a-z0-9_]") | x["r"].rlike("[A-Za-z0-9_]"), -1).otherwise(1),
        "variety": F.when(shown >= 5, 1).otherwise(-1),
    }


def reliabilities(patterns: DataFrame, rounds: int = 12, strength: float = 20.0) -> Column:
    """EM over (votes, n): the posterior of a pattern, as an expression over the vote columns.

    Each labeler has a hit rate on true spans and one on false spans; both start
    at 0.8 and are smoothed towards it with a weight of `strength` candidates.
    """
    prior, rate = 0.5, {j: (0.8, 0.8) for j in LABELERS}

    def posterior():
        z = F.lit(math.log(prior / (1 - prior)))
        for j, (a, b) in rate.items():
            z = z + F.when(F.col(j) > 0, math.log(a / (1 - b))).when(F.col(j) < 0, math.log((1 - a) / b)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    for _ in range(rounds):
        p, n = F.col("p"), F.col("n")
        got = patterns.withColumn("p", posterior()).agg(
            F.sum(n).alias("n"), F.sum(n * p).alias("yes"),
            *[F.sum(F.when(c, n * w)).alias(f"{name}_{j}") for j in LABELERS for name, c, w in (
                ("hit", F.col(j) > 0, p), ("on", F.col(j) != 0, p), ("miss", F.col(j) < 0, 1 - p), ("off", F.col(j) != 0, 1 - p))]).first()
        if not got["n"]:
            break
        prior = (got["yes"] + strength / 2) / (got["n"] + strength)
        rate = {j: (((got[f"hit_{j}"] or 0) + 0.8 * strength) / ((got[f"on_{j}"] or 0) + strength),
                    ((got[f"miss_{j}"] or 0) + 0.8 * strength) / ((got[f"off_{j}"] or 0) + strength)) for j in LABELERS}
    return posterior()


def shape(x: Column) -> dict[str, Column]:
    return {"kind": x["kind"], "length": F.least(F.length(x["m"]) / 4, F.lit(10)).cast("int"),
            "digits": F.least(F.length(digits(x["m"])) / 3, F.lit(6)).cast("int")}


def train(rows: DataFrame) -> dict:
    """{(feature, value): log odds} and the intercept under None, from soft labels."""
    x = F.col("x")
    named = saved(rows.select(*[v.alias(k) for k, v in votes(x).items()], *[v.alias(f"s_{k}") for k, v in shape(x).items()])
                  .groupBy(*LABELERS, *[f"s_{k}" for k in shape(x)]).agg(F.count("*").alias("n")), "patterns")
    soft = named.withColumn("p", reliabilities(named.groupBy(*LABELERS).agg(F.sum("n").alias("n"))))
    names = [*LABELERS, *[f"s_{k}" for k in shape(x)]]
    cells = (soft.select("n", "p", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in names])).alias("e"))
             .groupBy("e.f", "e.v").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect())
    out: dict = {None: 0.0}
    for f in names:
        own = [c for c in cells if c.f == f]
        yes, no = sum(c.yes for c in own), sum(c.no for c in own)
        for c in own:
            out[f, c.v] = math.log((c.yes + 1) / (yes + len(own))) - math.log((c.no + 1) / (no + len(own)))
        if own:
            out[None] = math.log((yes + 1) / (no + 1))
    return out


def accepted(x: Column, model: dict, threshold: float) -> Column:
    features = votes(x) | {f"s_{k}": v for k, v in shape(x).items()}
    z = F.lit(model[None])
    for f, v in features.items():
        own = [(k[1], w) for k, w in model.items() if k is not None and k[0] == f]
        if own:
            z = z + reduce(lambda c, kw: F.when(v == kw[0], kw[1]).otherwise(c), own, F.lit(0.0))
    return z >= math.log(threshold / (1 - threshold))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """Per input row: id, base and added, arrays of (start, kind, stop) with kind an index of KINDS, by start then kind."""
    made = saved(candidates(docs, id_col, text_col), "candidates")
    model = train(made.select(F.explode("c").alias("x")))
    place = lambda x: F.struct(x["start"], x["kind"], x["stop"])
    made = made.select("id", "c", F.sort_array(F.transform(
        F.filter("c", lambda x: (x["kind"] < BASE) & valid(x)), place)).alias("base"))
    more = F.filter("c", lambda x: (x["kind"] >= BASE) & accepted(x, model, threshold) & ~F.exists(
        "base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return made.select(F.col("id").alias(id_col), "base", F.sort_array(F.transform(more, place)).alias("added"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def op1(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.sort_array(F.concat("base", "added"))).alias("spans"))
