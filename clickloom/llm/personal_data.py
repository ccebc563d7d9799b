"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Base patterns find spans that always stay. Further patterns find candidates that the base forms miss: numbers
run together, forms without a plus sign, written-out addresses. Labelers by form, check rule, gazetteer, context
word and edges vote for, against or not at all on all of them. Expectation-maximisation over the table of vote
patterns estimates how reliable each labeler is for each kind; a naive Bayes classifier over the spans' features
is trained on the resulting probabilities and accepts candidates. All of it is DataFrame work: texts are read
once, spans are rows, and the tables of votes and weights are bounded by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import discard, keep

KINDS = ("email", "ip", "card", "phone")
#: The base forms. Possessive, and bound to the start of a run or the last match's end, so that
#: no run of letters or digits is tried from each of its places; the matches are those of the plain forms.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beside the base forms. Every repetition is bounded.
FURTHER = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64} ?[\[({]at[\])}] ?[A-Z0-9-]{1,63}(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {
    ("email", True): "@", ("ip", True): r"[0-9]\.[0-9]", ("card", True): "[0-9]{2}|[0-9][ -][0-9]", ("phone", True): r"\+[0-9]",
    ("email", False): r"(?i)[\[({]at[\])}]", ("ip", False): "[0-9A-Fa-f]:[0-9A-Fa-f]", ("card", False): "[0-9]{4}[ -]?[0-9]{4}", ("phone", False): "[0-9]{3}[ .-][0-9]{4}",
}
#: Gazetteers: last parts of mail hosts, country codes, words before personal data and words that deny it.
HOSTS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "eu", "de", "fr", "es", "it", "nl", "uk", "us", "ca", "ch", "at", "be")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
BEFORE = {
    "email": ("email", "e-mail", "mail", "mailto", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "client", "login", "from"),
    "card": ("card", "visa", "mastercard", "credit", "amex", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone"),
}
DENIED = ("version", "v", "release", "isbn", "issn", "order", "invoice", "section", "figure", "page", "chapter", "nr", "no", "id")

#: Features of the classifier that are no votes.
FEATURES = 5
VOTES = ("form", "rule", "gazetteer", "context", "edges")
#: Rounds of expectation-maximisation at most, and the change of a weight that ends them; how many spans' worth each class leans on the kind's own frequencies, so that
#: a class of few spans has no opinion of its own; the part that counts of what is no vote, as form and context
#: repeat each other; buckets of a feature's values; accepted probability.
ROUNDS, SETTLED, LEAN, DAMPED, BUCKETS, ACCEPTED = 12, 0.01, 10.0, 0.5, 4096, 0.5


# ---- spans of a text ------------------------------------------------------------------------------


def _digits(hit: Column) -> Column:
    return F.translate(hit, " ()+.-", "")


def _parts_fit(hit: Column) -> Column:
    """Whether all parts of a dotted number are at most 255, leading zeros aside."""
    plain = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _parts_fit(hit)
    if kind == "card":
        return F.when(n.between(12, 19), F.call_function("luhn_check", _digits(hit))).otherwise(False)
    return n.between(9, 15)


def _told(kind: str, base: bool, hits: str, gaps: str) -> Column:
    """Of each match: code points since the last one, its length, whether it is valid, and what stands beside it."""

    def told(hit: Column, i: Column) -> Column:
        before, behind = F.get(F.col(gaps), i), F.get(F.col(gaps), i + 1)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), i.alias("at"),
            F.length(before).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), _valid(kind, hit).alias("valid"),
            F.substring(hit, 1, 64).alias("hit"), F.right(before, F.lit(24)).alias("before"), F.substring(behind, 1, 1).alias("behind"),
        )

    return F.transform(F.coalesce(F.col(hits), F.array().cast("array<string>")), told)


def find_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, found``: of each row of ``docs`` the matches of all patterns. Texts are read here only."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")
    )
    patterns = [(kind, base) for base in (True, False) for kind in KINDS]
    matched = {}
    for k, (kind, base) in enumerate(patterns):
        pattern, hint = (BASE if base else FURTHER)[kind], HINT[kind, base]
        holds = F.contains(F.col("text"), F.lit(hint)) if hint == "@" else F.col("text").rlike(hint)
        matched[f"_hits{k}"] = F.when(holds, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        matched[f"_gaps{k}"] = F.when(holds, F.split("text", pattern, -1))
    told = [_told(kind, base, f"_hits{k}", f"_gaps{k}") for k, (kind, base) in enumerate(patterns)]
    return rows.withColumns(matched).select("row", "doc_id", F.concat(*told).alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """The spans as rows with ``start`` and ``end``: base spans, base matches that fail their rule, and what the
    further patterns add without touching a base span.

    Places are running sums along the matches of one pattern; what touches a base span is seen by running
    maxima of their ends from the left and minima of their starts from the right.
    """
    spans = found.where(F.size("found") > 0).select("row", F.explode("found").alias("_s")).select("row", "_s.*")
    along = Window.partitionBy("row", "kind", "base").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = spans.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size"))
    sure = F.col("base") & F.col("valid")
    left = Window.partitionBy("row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    touched = F.coalesce(F.max(F.when(sure, F.col("end"))).over(left) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(sure, F.col("start"))).over(right) < F.col("end"), F.lit(False)
    )
    # A base match of another size than the kind's is no candidate: most numbers are none.
    sized = sure | ~F.col("base") | (F.col("kind") != KINDS.index("card")) | F.length(_digits(F.col("hit"))).between(12, 19)
    return placed.withColumn("_touched", touched).where(sure | (~F.col("_touched") & sized)).drop("_touched", "gap", "at")


# ---- labelers and features ------------------------------------------------------------------------


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _by_kind(votes: dict[str, Column]) -> Column:
    value = F.lit(0)
    for k, kind in enumerate(KINDS):
        value = F.when(F.col("kind") == k, votes[kind]).otherwise(value)
    return value


def _card_rule(hit: Column) -> Column:
    return _vote(F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit)), F.lit(True))


def with_votes(spans: DataFrame) -> DataFrame:
    """Adds a column for each labeler: 1 for personal data, -1 against, 0 where it has nothing to say."""
    hit, never = F.col("hit"), F.lit(False)
    digits = _digits(hit)
    host = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)[\])}]*$", 1))
    first = F.expr("try_cast(regexp_extract(hit, '^[0-9]+', 0) AS int)")
    area = F.regexp_extract(hit, r"([0-9])[0-9]{2}\)?[ .-]*([0-9])[0-9]{2}[ .-]*[0-9]{4}$", 1)
    country = F.regexp_extract(hit, r"^\+([0-9]{1,3})(?:[^0-9]|$)", 1)
    word = F.lower(F.regexp_extract("before", r"([\p{L}-]+)[\s:=.#(]*$", 1))
    edge = r"^[\s,.;:!?()\[\]{}<>\"'/=]?$"
    clean_left, clean_right = F.right("before", F.lit(1)).rlike(edge), F.col("behind").rlike(edge)
    return spans.withColumns({
        "form": _vote(F.col("base") & F.col("valid"), F.col("base")),
        "rule": _by_kind({
            "email": _vote(host.rlike("^[a-z]{2,}$"), F.lit(True)),
            "ip": _vote(F.col("valid"), F.col("base")),
            "card": _card_rule(hit),
            "phone": _vote(F.length(digits).between(10, 13) & ~area.isin("0", "1"), ~F.length(digits).between(9, 15)),
        }),
        "gazetteer": _by_kind({
            "email": _vote(host.isin(*HOSTS), never),
            "ip": _vote(first.between(1, 223), first.isNotNull() & F.col("base")),
            "card": _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"), F.lit(True)),
            "phone": _vote(country.isin(*COUNTRIES), (country != "") & ~country.isin(*COUNTRIES)),
        }),
        "context": F.when(word.isin(*DENIED), -1).otherwise(_by_kind({kind: _vote(word.isin(*BEFORE[kind]), never) for kind in KINDS})),
        "edges": _vote(clean_left & clean_right, F.lit(True)),
    })


def _features() -> Column:
    """What the classifier sees of a span: a number below ``BUCKETS`` for each of its features' values, the votes
    among them; null where a labeler says nothing."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("hit", r"\p{L}+", "a"), "[0-9]{4,}", "9+"), "[0-9]", "9")
    word = F.lower(F.regexp_extract("before", r"([\p{L}-]+)[^\p{L}]*$", 1))
    said = {
        "shape": F.substring(shape, 1, 24), "word": word, "left": F.right("before", F.lit(1)), "right": F.col("behind"),
        "digits": F.least(F.length(_digits(F.col("hit"))), F.lit(20)).cast("string"),
        **{vote: F.when(F.col(vote) != 0, F.col(vote).cast("string")) for vote in VOTES},
    }
    return F.array(*[
        F.struct(F.lit(k).alias("feature"), F.when(value.isNotNull(), F.pmod(F.xxhash64(F.lit(name), value), F.lit(BUCKETS))).alias("value"))
        for k, (name, value) in enumerate(said.items())
    ])


# ---- reliabilities and classifier -----------------------------------------------------------------


def _chance(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(log_odds, F.lit(-50.0)), F.lit(50.0))))


def _posterior(weights: dict[int, tuple[float, list[list[float]]]]) -> Column:
    """Probability by votes: ``weights`` has a prior and a weight for each labeler's vote, by kind."""
    value = F.lit(0.0)
    for kind, (prior, by_vote) in weights.items():
        total = F.lit(prior)
        for name, of_vote in zip(VOTES, by_vote):
            total = total + F.get(F.array(*map(F.lit, of_vote)), F.col(name) + 1)
        value = F.when(F.col("kind") == kind, total).otherwise(value)
    return _chance(value)


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> dict[int, tuple[float, list[list[float]]]]:
    """Log odds of the prior and of each labeler's votes -1, 0, 1, by kind, from ``kind``, votes, ``n``.

    The table has one row for each pattern of votes, 4 x 3^5 at most. Rounds start from the plain sum of the
    votes. Saying nothing weighs nothing, and no labeler is believed to vote the wrong way round: without these
    two rules the two classes would part usual spans from unusual ones. A round is one aggregate, of which four
    rows of sums come back; rounds end when no weight moves by ``SETTLED``.
    """
    posterior = _chance(sum((F.col(v) for v in VOTES), F.lit(0.0)))
    weights: dict[int, tuple[float, list[list[float]]]] = {}
    settled = False
    while rounds and not settled:
        before, rounds = weights, rounds - 1
        weighed = patterns.withColumn("_p", posterior)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_p")).alias("yes")]
        for vote in VOTES:
            for value in (-1, 1):
                here = F.when(F.col(vote) == value, F.col("n")).otherwise(0)
                sums += [F.sum(here).alias(f"{vote}{value}"), F.sum(here * F.col("_p")).alias(f"{vote}{value}yes")]
        weights = {}
        for row in weighed.groupBy("kind").agg(*sums).collect():
            yes, no = row["yes"], row["n"] - row["yes"]
            by_vote = []
            for vote in VOTES:
                yes_voted = sum(row[f"{vote}{v}yes"] for v in (-1, 1))
                voted = sum(row[f"{vote}{v}"] for v in (-1, 1))
                weight = {0: 0.0}
                for v in (-1, 1):
                    of_yes, n, usual = row[f"{vote}{v}yes"], row[f"{vote}{v}"], LEAN * (row[f"{vote}{v}"] + 1) / (voted + 2)
                    odds = math.log((of_yes + usual) / (yes_voted + LEAN)) - math.log((n - of_yes + usual) / (voted - yes_voted + LEAN))
                    weight[v] = v * max(0.0, v * odds)
                by_vote.append([weight[v] for v in (-1, 0, 1)])
            weights[row["kind"]] = (math.log((yes + 1) / (no + 1)), by_vote)
        flat = {kind: [prior, *(w for votes in by_vote for w in votes)] for kind, (prior, by_vote) in weights.items()}
        was = {kind: [prior, *(w for votes in by_vote for w in votes)] for kind, (prior, by_vote) in before.items()}
        settled = flat.keys() == was.keys() and all(abs(a - b) < SETTLED for kind in flat for a, b in zip(flat[kind], was[kind]))
        posterior = _posterior(weights)
    return weights


def classifier(spans: DataFrame, posterior: Column) -> tuple[DataFrame, DataFrame]:
    """Naive Bayes weights (kind, feature, value, weight) and priors (kind, prior, unseen) from spans with votes.

    At most ``BUCKETS`` values for each of ten features and four kinds, whatever the corpus.
    """
    weighed = spans.select("kind", posterior.alias("_p"), F.explode(_features()).alias("_f")).select("kind", "_p", "_f.*")
    yes, all_ = F.sum(F.col("_p").cast("decimal(20,9)")).cast("double"), F.count(F.lit(1))
    by_value = weighed.where("value IS NOT NULL").groupBy("kind", "feature", "value").agg(yes.alias("yes"), all_.alias("n"))
    priors = weighed.where("feature = 0").groupBy("kind").agg(yes.alias("all_yes"), all_.alias("all_n"))
    values = by_value.groupBy("kind", "feature").agg(F.count(F.lit(1)).alias("values"))
    usual = F.lit(LEAN) * (F.col("n") + 1) / (F.col("all_n") + F.col("values"))
    share = lambda part, whole: F.log((part + usual) / (whole + LEAN))
    counted = F.when(F.col("feature") < FEATURES, F.lit(DAMPED)).otherwise(F.lit(1.0))
    weights = by_value.join(F.broadcast(values), ["kind", "feature"]).join(F.broadcast(priors), "kind").select(
        "kind", "feature", "value",
        (counted * (share(F.col("yes"), F.col("all_yes")) - share(F.col("n") - F.col("yes"), F.col("all_n") - F.col("all_yes")))).alias("weight"),
    )
    prior = F.log((F.col("all_yes") + 1) / (F.col("all_n") - F.col("all_yes") + 1))
    return weights, priors.select("kind", prior.alias("prior"))


def _said(spans: Column) -> Column:
    """``kind:start:end`` in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row of ``docs``.

    Counts and the digest are of the base spans; ``spans`` holds these and the accepted candidates, as
    ``kind:start:end`` in code points by start and then kind. Null and empty texts have no spans, repeated rows
    and null ids are rows like others, an empty table gives no rows; no other column is read. Labelers,
    classifier and counts see all rows.
    """
    spark = docs.sparkSession
    found = keep(find_spans(docs, id, text), "found-spans")
    voted = keep(with_votes(candidates(found)), "voted-spans")
    # A few hundred rows at most: one partition, in a fixed order, so that sums are the same each time.
    patterns = keep(voted.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions("kind", *VOTES), "votes")
    weights = reliabilities(patterns.coalesce(1))
    by_value, priors = classifier(voted, _posterior(weights))
    by_value = keep(by_value, "weights")
    further = voted.where("NOT base").select("row", "kind", "start", "end", F.explode(_features()).alias("_f")).select("row", "kind", "start", "end", "_f.*")
    scored = (
        further.join(F.broadcast(by_value), ["kind", "feature", "value"], "left")
        .groupBy("row", "kind", "start", "end").agg(F.sum(F.coalesce("weight", F.lit(0.0)).cast("decimal(20,9)")).cast("double").alias("_w"))
        .join(F.broadcast(priors), "kind")
    )
    added = scored.where(_chance(F.col("prior") + F.col("_w")) >= ACCEPTED).select("row", "kind", "start", "end", F.lit(False).alias("base"))
    spans = voted.where("base AND valid").select("row", "kind", "start", "end", "base").union(added)
    span = F.struct("start", "kind", "end")
    per_row = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.collect_list(F.when(F.col("base"), span)).alias("_base"), F.collect_list(span).alias("_all"),
    ).select("row", *[f"n_{kind}" for kind in KINDS], _said(F.col("_base")).alias("_base"), _said(F.col("_all")).alias("spans"))
    discard(spark, patterns)
    return found.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
