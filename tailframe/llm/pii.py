"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the labelers, a classifier decides.

Everything is DataFrame expressions: no Python runs on rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Runs are taken whole (possessive), and a run is tried from its first character or where the match before it ended:
#: the leftmost match begins there, and a long run is read once. Behind a dot or a digit group nothing has to be given back, so groups are possessive too.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, whose matches are candidates only: written-out addresses, card numbers with other gaps, national phone numbers.
WIDE = {
    "email": rf"(?<![{LOCAL}@])[A-Za-z0-9_%+-][{LOCAL}]{{0,63}}\x20?[(\[]\x20?(?:at|AT|@)\x20?[)\]]\x20?[A-Za-z0-9-]{{1,63}}(?:(?:\.|\x20?[(\[]\x20?(?:dot|DOT)\x20?[)\]]\x20?)[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "card": r"(?<![0-9.])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z./+-])\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9A-Za-z-]|[\x20./][0-9])",
}
#: What a text must hold before a pattern is tried on it.
GATE = {"email": "@", "ip": ".", "phone": "+", "card": ""}
WIDE_GATE = {"email": r"(?i)[(\[]\x20?(?:at|@)\x20?[)\]]", "card": r"[0-9]{4}[./][0-9]{4}", "phone": r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3}"}
#: Code points before and behind a match that context labelers see.
BEFORE, BEHIND = 32, 8
#: Gazetteers: fixed values, known prefixes of card issuers, common ends of host names, words that announce a kind or another number.
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)|35|62|50|5[6-9]|6[0-9])"
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|dev|de|fr|es|uk|it|nl|pl|eu|us|ca|ch|at|be|br|mx)$"
CUES = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|correo|courriel|kontakt|from|to)\W{0,4}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|client|login|from|adresse|dirección)\W{0,4}(?:v4)?\W{0,2}$",
    "card": r"(?i)(?:card|visa|credit|debit|amex|mastercard|carte|karte|tarjeta|payment|pan)\W{0,4}(?:no|number|nr)?\W{0,4}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp|telefon|téléphone|teléfono|handy|contact)\w{0,6}\W{0,4}(?:no|number|nr)?\W{0,4}$",
}
OTHER = r"(?i)(?:version|release|\bv|isbn|issn|order|invoice|serial|article|section|chapter|page|total|price|amount|sku|build|ref|lot|item|\bid|\bno|[$€£#])\W{0,3}$"
#: Labelers in order: each says 1 (personal data), -1 (not) or 0 (nothing) of a candidate.
LABELERS = ("pattern", "structure", "gazetteer", "cue", "other_number", "edges", "variety")
#: Rounds of expectation-maximisation; right answers of how many a labeler has before any is counted, the most that it is trusted, and the smoothing of the share of true spans.
ROUNDS, SURE, MOST, SMOOTH = 12, (4.0, 5.0), 0.99, 1.0
#: Steps of the classifier's descent, their rate and the weights' decay; from what probability a span is added.
STEPS, RATE, DECAY, THRESHOLD = 40, 2.0, 1e-3, 0.9


def found_in(text: Column, pattern: str, gate: Column) -> Column:
    """array of (gap, hit, before, behind): all matches in order, with the code points between each and the one before, and what stands around it."""
    none = F.array().cast("array<struct<gap:int,hit:string,before:string,behind:string>>")
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.transform(
        hits,
        lambda hit, n: F.struct(
            F.char_length(F.get(gaps, n)).alias("gap"), hit.alias("hit"), F.right(F.get(gaps, n), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, n + 1), F.lit(BEHIND)).alias("behind")
        ),
    )
    return F.coalesce(F.when(gate, both), none)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def octets_fit(hit: Column) -> Column:
    """Four numbers up to 255, however many zeros they begin with."""
    return F.forall(F.split(hit, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_holds(kind: str, hit: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    size = F.char_length(digits_of(hit))
    return {
        "email": F.lit(True),
        "ip": octets_fit(hit),
        "card": F.when(size.between(16, 19), F.call_function("luhn_check", digits_of(hit))).otherwise(F.lit(False)),
        "phone": size.between(8, 15),
    }[kind]


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, rid and the matches of every pattern, of every row: the one pass over the texts, stored."""
    x = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("k"), F.monotonically_increasing_id().alias("rid"), x.alias("x"))
    out = rows.select(
        "k", "rid",
        *(found_in(F.col("x"), BASE[k], F.contains("x", F.lit(GATE[k])) if GATE[k] else F.col("x").rlike("[0-9]")).alias(f"base_{k}") for k in KINDS),
        *(found_in(F.col("x"), p, F.col("x").rlike(WIDE_GATE[k])).alias(f"wide_{k}") for k, p in WIDE.items()),
    )
    return materialize(out, "scanned")


def placed(rows: DataFrame, column: str, kind: str, base: bool) -> DataFrame:
    """rid, kind_no, base, start, stop, hit, before, behind: matches with their places, by running sums within a text."""
    m = rows.where(F.size(column) > 0).select("rid", F.posexplode(column).alias("pos", "m")).select("rid", "pos", "m.*")
    w = W.partitionBy("rid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    m = m.withColumn("stop", F.sum(F.col("gap") + F.char_length("hit")).over(w))
    return m.select("rid", F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(base).alias("base"), (F.col("stop") - F.char_length("hit")).alias("start"), "stop", "hit", "before", "behind")


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0))


def by_kind(of: dict[str, Column]) -> Column:
    """The expression of the row's kind."""
    return reduce(lambda out, k: out.when(F.col("kind_no") == KINDS.index(k), of[k]), KINDS[1:], F.when(F.col("kind_no") == 0, of[KINDS[0]]))


def with_votes(spans: DataFrame) -> DataFrame:
    """Adds what every labeler says of a candidate, and the classifier's own features (size, separators)."""
    digits, size = digits_of(F.col("hit")), F.char_length(digits_of(F.col("hit")))
    host = F.regexp_extract("hit", r"([A-Za-z0-9-]+)$", 1)
    structure = {
        "email": vote(host.rlike("^[A-Za-z]{2,12}$"), F.lit(True)),
        "ip": vote(octets_fit(F.col("hit")), F.lit(True)),
        "card": vote(F.when(size.between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False)), F.lit(True)),
        "phone": vote(size.between(8, 15), F.lit(True)),
    }
    gazetteer = {
        "email": vote(host.rlike(DOMAINS), ~host.rlike("[A-Za-z]")),
        "ip": vote(~F.col("hit").rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), F.col("hit").rlike(r"^(?:0|127)\.")),
        "card": vote(digits.rlike(CARD_ISSUERS), F.lit(True)),
        "phone": vote(F.col("hit").startswith("+") & ~digits.startswith("0"), ~F.col("hit").startswith("+") & digits.rlike(r"^[01]{2}")),
    }
    cue = by_kind({k: vote(F.col("before").rlike(p)) for k, p in CUES.items()})
    glued = F.col("before").rlike(r"[0-9A-Za-z_/=#]$") | F.col("behind").rlike(r"^(?:[0-9A-Za-z_=]|[.,/-][0-9])")
    alike = by_kind({k: (F.lit(False) if k == "email" else digits.rlike(r"^(.)\1*$") if k != "ip" else F.col("hit").rlike(r"^([0-9]+)(?:\.\1){3}$")) for k in KINDS}) | F.contains(F.lit("01234567890123456789"), digits) & (size > 0)
    votes = {
        "pattern": vote(F.col("base")), "structure": by_kind(structure), "gazetteer": by_kind(gazetteer), "cue": cue, "other_number": vote(F.lit(False), F.col("before").rlike(OTHER)),
        "edges": vote(F.lit(False), glued), "variety": vote(F.lit(False), alike),
    }
    return spans.withColumns({**{f"v_{n}": votes[n] for n in LABELERS}, "many": (size >= 10).cast("int"), "parted": F.col("hit").rlike(r"[\x20./()-]").cast("int")})


VOTES = [f"v_{n}" for n in LABELERS]


def answers() -> list[Column]:
    """A constant, and yes and no of every labeler, as ones and zeros."""
    return [F.lit(1.0), *(F.when(F.col(v) == a, 1.0).otherwise(0.0) for v in VOTES for a in (1, -1))]


def features() -> Column:
    """What the classifier sees of a span: the labelers' answers and the span's form."""
    return F.array(*answers(), F.col("many").cast("double"), F.col("parted").cast("double"))


def chance(x: str, weights: list[list[float]]) -> Column:
    """The logistic function of the row's vector x times its kind's weights. Weights are one array value, so every round runs the same compiled plan."""
    own = F.get(F.array(*(F.array(*(F.lit(float(c)) for c in w)) for w in weights)), F.col("kind_no"))
    return 1 / (1 + F.exp(-F.aggregate(F.zip_with(x, own, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))


def sums_by_kind(patterns: DataFrame, x: str, value: Column) -> dict[tuple[int, int], float]:
    """Of each kind and place of the vector x, the sum of value * x: some 20 numbers a kind, whatever the number of spans."""
    rows = patterns.withColumn("_v", value).select("kind_no", "_v", F.posexplode(x).alias("i", "c")).groupBy("kind_no", "i").agg(F.sum(F.col("_v") * F.col("c")).alias("s"))
    return {(r["kind_no"], r["i"]): r["s"] for r in rows.collect()}


def log_odds(x: float) -> float:
    return math.log(x / (1 - x))


def weighed(patterns: DataFrame) -> DataFrame:
    """patterns (kind_no, votes, times) with p, the probability that such a span is personal data.

    A labeler that says something is right with a chance of its own for each kind; one that says nothing tells nothing. Expectation-maximisation starts
    from the majority and fits the chances and the share of true spans; a chance begins at SURE[0] of SURE[1] answers and is never taken for less than one half, as what a labeler says is not
    evidence of the opposite. ``patterns`` is a stored table of at most kinds * 3^labelers * 4 rows, however many spans there are; a round is one
    small aggregation, whose sums weigh the next round.
    """
    total = reduce(lambda a, b: a + b, (F.col(v) for v in VOTES))
    p = F.when(total > 1, F.lit(0.9)).when(total < 1, F.lit(0.1)).otherwise(F.lit(0.5))  # one voice alone leaves it open
    patterns = patterns.withColumn("x", F.array(*answers()))
    spans = sums_by_kind(patterns, "x", F.col("times"))
    for _ in range(ROUNDS):
        true = sums_by_kind(patterns, "x", F.col("times") * p)
        weights = []
        for kind in range(len(KINDS)):
            share = (true.get((kind, 0), 0.0) + SMOOTH) / (spans.get((kind, 0), 0.0) + 2 * SMOOTH)
            own = [log_odds(share)]
            for i in range(1, 2 * len(VOTES), 2):
                said = spans.get((kind, i), 0.0) + spans.get((kind, i + 1), 0.0)
                right = true.get((kind, i), 0.0) + spans.get((kind, i + 1), 0.0) - true.get((kind, i + 1), 0.0)
                weight = log_odds(min(max((right + SURE[0]) / (said + SURE[1]), 0.5), MOST))
                own += [weight, -weight]
            weights.append(own)
        p = chance("x", weights)
    return patterns.withColumn("p", p).drop("x")


def classifier(soft: DataFrame) -> list[list[float]]:
    """Weights, by kind, of a logistic regression on ``features`` fitted to the soft labels p of the stored patterns, by descent along the mean gradient.

    A step is one aggregation of the bounded pattern table.
    """
    soft = soft.withColumn("x", features())
    size = 3 + 2 * len(VOTES)
    weights = [[0.0] * size for _ in KINDS]
    times = sums_by_kind(soft, "x", F.col("times"))  # the constant's sum is the number of spans
    for _ in range(STEPS):
        g = sums_by_kind(soft, "x", (F.col("p") - chance("x", weights)) * F.col("times"))
        weights = [[c + RATE * (g.get((kind, i), 0.0) / max(times.get((kind, 0), 0.0), 1.0) - DECAY * c) for i, c in enumerate(w)] for kind, w in enumerate(weights)]
    return weights


def without_overlaps(spans: DataFrame) -> DataFrame:
    """The base spans, and of the others those that meet neither a base span nor one of the others that begins earlier (or as early, with a smaller kind)."""
    order = W.partitionBy("rid").orderBy("start", "stop", "kind_no", "base")
    past, ahead = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    seen = F.when(F.col("base"), F.col("stop"))
    out = spans.withColumns({"_p": F.max(seen).over(past), "_n": F.min(F.when(F.col("base"), F.col("start"))).over(ahead)})
    free = F.coalesce(F.col("_p") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_n") >= F.col("stop"), F.lit(True))
    out = out.where(F.col("base") | free).withColumn("_o", F.max(F.when(~F.col("base"), F.col("stop"))).over(past))
    return out.where(F.col("base") | F.coalesce(F.col("_o") <= F.col("start"), F.lit(True))).drop("_p", "_n", "_o")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every row.

    A base span is a leftmost match of its kind's pattern that holds (``base_holds``); a match that does not is dropped, and the search goes on behind it. Candidates are
    the base spans, the base patterns' failed matches of ten digits or more, and matches of wider patterns. All of them are voted on and teach; of those that are no base span,
    the ones of right structure (check digit, number of digits, octets) to which the classifier gives ``threshold`` or more are added, unless they overlap a base span or an added one that begins earlier.

    Places are in code points, end exclusive; spans are ordered by kind, then start. Null texts are empty and, like texts without a match, have no
    spans: an empty string, whose digest is base_sha256. Null and repeated keys are rows like others, equal rows have equal results, an empty table gives no rows, other
    columns are ignored. A text's own matches meet in one task, texts themselves are read once and not shuffled.
    """
    rows = scanned(docs, key, text)
    spans = [placed(rows, f"base_{k}", k, True).withColumn("base", base_holds(k, F.col("hit"))).where(F.col("base") | (F.char_length(digits_of(F.col("hit"))) >= 10)) for k in KINDS]
    spans += [placed(rows, f"wide_{k}", k, False) for k in WIDE]
    voted = materialize(with_votes(reduce(DataFrame.unionByName, spans)).drop("hit", "before", "behind"), "spans")
    patterns = materialize(voted.groupBy("kind_no", *VOTES, "many", "parted").agg(F.count("*").alias("times")).coalesce(1), "patterns")
    soft = materialize(weighed(patterns).coalesce(1), "weighed")
    kept = voted.withColumn("x", features()).withColumn("p", chance("x", classifier(soft))).where(F.col("base") | ((F.col("p") >= threshold) & (F.col("v_structure") == 1))).select("rid", "kind_no", "start", "stop", "base")
    kept = without_overlaps(kept)
    names = F.array(*(F.lit(k) for k in KINDS))
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    groups = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind_no", "start", "stop", "base"))).alias("all"), *(F.count_if(F.col("base") & (F.col("kind_no") == n)).alias(f"n_{k}") for n, k in enumerate(KINDS)))
    groups = groups.select("rid", *(f"n_{k}" for k in KINDS), written(F.filter("all", lambda s: s["base"])).alias("base_text"), written(F.col("all")).alias("spans"))
    out = rows.select("k", "rid").join(groups, "rid", "left")
    return out.select(
        F.col("k").alias(key), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base_text", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def op13_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
