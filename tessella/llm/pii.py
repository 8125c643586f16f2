"""Operator 10, personal data: fixed formats, and weak labelers weighed by expectation-maximisation that train a span classifier. JVM only.

The plain Python below works on counts of vote patterns, a few hundred rows at most whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import documents, stage

KINDS = ("email", "ip", "card", "phone")
LABEL = "[A-Za-z0-9-]"
#: Fixed formats after `_joints`; equal to the contract's, written so that no group repeats (Java recurses on those).
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{S.JOINT}-]))[A-Za-z0-9._%+{S.JOINT}-]++@{LABEL}++{S.JOINT}[A-Za-z0-9{S.JOINT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9{S.JOINT}\x04]{{2,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates for the model: grouped digits that may be a local number, an account or a document number.
CANDIDATE = r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,6}){1,3}(?![0-9A-Za-z])"
#: Gazetteer of words that announce personal data, and cues that stand right before it.
GAZETTEER = "phone tel telephone mobile cell fax call whatsapp ssn passport account iban licence license birth dob born telefon handy konto ausweis geburtsdatum téléphone portable compte passeport né teléfono móvil cuenta pasaporte nacimiento".split()
VOTES = "cast(array() as array<struct<start:int,end:int,votes:int>>)"
LABELERS = ("shape", "gazetteer", "cue", "apart", "length")


def _email(text: Column) -> Column:
    joints = F.regexp_replace(text, rf"(?<={LABEL})\.(?={LABEL})", S.JOINT)
    return S.find(joints, EMAIL)


def _card(text: Column) -> Column:
    joints = F.regexp_replace(F.regexp_replace(text, r"(?<=[0-9])\x20(?=[0-9])", S.JOINT), r"(?<=[0-9])-(?=[0-9])", "\x04")
    digits = lambda m: F.regexp_replace(m["value"], "[^0-9]", "")

    def luhn(d):
        n = F.length(d)
        digit = lambda k: F.substring(d, k, F.lit(1)).cast("int")
        one = lambda k: F.when((n - k) % 2 == 0, digit(k)).otherwise(F.when(digit(k) > 4, digit(k) * 2 - 9).otherwise(digit(k) * 2))
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda t, k: t + one(k)) % 10 == 0

    return F.filter(S.find(joints, CARD), lambda m: F.when(F.length(digits(m)).between(13, 19), luhn(digits(m))).otherwise(False))


def _ip(text: Column) -> Column:
    low = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    fits = lambda p: F.when(low(p), F.coalesce(F.when(F.ltrim(p, F.lit("0")) == "", 0).otherwise(F.ltrim(p, F.lit("0")).try_cast("int")), F.lit(0)) <= 255).otherwise(False)
    return F.filter(S.find(text, IP), lambda m: F.forall(F.split(m["value"], r"\."), fits))


def _phone(text: Column) -> Column:
    return F.filter(S.find(text, PHONE), lambda m: F.length(F.regexp_replace(m["value"], "[^0-9]", "")).between(9, 15))


def base_spans(docs: DataFrame) -> DataFrame:
    """`docs` with `_email`, `_ip`, `_card`, `_phone` and `base`, all of them by kind, then start. A null text is empty.

    Columns of `docs` with these names or those of the candidates are replaced.
    """
    docs = docs.drop("base", "found", "_open", "_candidates", *(f"_{k}" for k in KINDS))
    raw = F.coalesce(F.col("text"), F.lit(""))
    text = F.translate(S.plain(raw), "\x04", "\x03")
    when = lambda has, spans: F.when(has, spans).otherwise(S.none())
    out = docs.select(
        "*",
        when(raw.contains("@"), _email(text)).alias("_email"),
        when(raw.rlike(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]"), _ip(text)).alias("_ip"),
        when(raw.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _card(text)).alias("_card"),
        when(raw.rlike(r"\+[0-9]"), _phone(text)).alias("_phone"),
    )
    return out.withColumn("base", F.concat(*(S.tagged(F.col(f"_{k}"), k, n) for n, k in enumerate(KINDS))))


def votes(docs: DataFrame) -> DataFrame:
    """`docs` (with base spans) and `_candidates`: start, end, and the votes of LABELERS (1 for, 0 against, -1 none) in one number.

    Base spans are among the candidates, as examples whose format is certain. A null text has no candidates.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    more = F.when(raw.rlike(r"[0-9]\)?[\x20./-][0-9]"), S.find(S.plain(raw), CANDIDATE)).otherwise(S.none())
    words = "|".join(GAZETTEER)

    def vote(m, sure, pieces):
        before = F.lower(S.part(pieces, F.greatest(m["start"] - 30, F.lit(0)), m["start"]))
        after = S.part(pieces, m["end"], m["end"] + 1)
        digits = F.length(F.regexp_replace(m["value"], "[^0-9]", ""))
        marks = (
            F.when(sure | m["value"].rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 1).otherwise(0),
            F.when(before.rlike(rf"(?<![a-zà-ü])(?:{words})(?![a-zà-ü])"), 1).otherwise(-1),
            F.when(before.rlike(r"[:#=]\x20*$"), 1).otherwise(-1),
            F.when(before.rlike(r"[0-9%$€£]\x20*$") | after.rlike("[%$€£°]"), 0).otherwise(-1),
            F.when(digits.between(9, 16), 1).otherwise(0),
        )
        number = F.lit(0)
        for v in marks:
            number = number * 3 + v + 1
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), (number * 2 + sure.cast("int")).alias("votes"))

    voted = lambda spans, sure: S.let(spans, lambda s: F.when(F.size(s) == 0, F.expr(VOTES)).otherwise(S.let(S.chunks(raw), lambda p: F.transform(s, lambda m: vote(m, F.lit(sure), p)))))
    sure = voted(F.concat(*(F.col(f"_{k}") for k in KINDS)), True)
    open_ = voted(S.apart(more, F.col("base")), False)
    return docs.withColumn("_open", open_).withColumn("_candidates", F.concat(sure, "_open"))


def _unpacked(number: int) -> list[int]:
    out, number = [], number // 2
    for _ in LABELERS:
        out.append(number % 3 - 1)
        number //= 3
    return out[::-1]


def reliabilities(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Expectation-maximisation over vote patterns: the chance that a candidate of each pattern is personal data."""
    rate, right = 0.5, [[0.3, 0.7] for _ in LABELERS]  # chance of a vote for, of those that vote, by true class
    post = {}
    for _ in range(rounds):
        for number in counts:
            odds = math.log(rate / (1 - rate))
            for k, v in enumerate(_unpacked(number)):
                if v >= 0:
                    p0, p1 = right[k] if v else (1 - right[k][0], 1 - right[k][1])
                    odds += math.log(p1 / p0)
            post[number] = 1.0 if number % 2 else 1 / (1 + math.exp(-max(-30, min(30, odds))))  # a certain format is an anchor
        total = sum(counts.values()) or 1
        rate = min(0.99, max(0.01, sum(n * post[c] for c, n in counts.items()) / total))
        for k in range(len(LABELERS)):
            for y in (0, 1):
                of = [(n * (post[c] if y else 1 - post[c]), _unpacked(c)[k]) for c, n in counts.items() if _unpacked(c)[k] >= 0]
                right[k][y] = (sum(w for w, v in of if v) + (1.4 if y else 0.6)) / (sum(w for w, _ in of) + 2)
    return post


def classifier(counts: dict[int, int], post: dict[int, float], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic weights over (votes for, votes against) of each labeler, fitted to the posteriors; the intercept is last."""
    x = {c: [float(v == s) for v in _unpacked(c) for s in (1, 0)] + [1.0] for c in counts}
    w = [0.0] * (2 * len(LABELERS) + 1)
    total = sum(counts.values()) or 1
    for _ in range(rounds):
        g = [1e-3 * v for v in w]
        for c, n in counts.items():
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x[c], strict=True))))))
            for k, v in enumerate(x[c]):
                g[k] += (p - post[c]) * v * n / total
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def train(docs: DataFrame) -> set[int]:
    """The vote patterns that the final classifier takes for personal data, from the candidates of all documents.

    Null texts have none; repeated rows count each; null ids count like any other.
    """
    return accepted(votes(base_spans(docs)))


def accepted(voted: DataFrame) -> set[int]:
    """`train` from the rows of `votes`."""
    rows = voted.select(F.explode("_candidates.votes").alias("votes")).groupBy("votes").count().collect()
    counts = {r.votes: r["count"] for r in rows}
    w = classifier(counts, reliabilities(counts))
    keep = set()
    for number in counts:
        x = [float(v == s) for v in _unpacked(number) for s in (1, 0)] + [1.0]
        if sum(a * b for a, b in zip(w, x, strict=True)) >= 0:
            keep.add(number)
    return keep


def scan(docs: DataFrame, keep: set[int]) -> DataFrame:
    """`docs` with `base` and `found` (base and model spans, kind "model"), each by kind, then start. A null text has none."""
    return with_model(votes(base_spans(docs)), keep)


def with_model(voted: DataFrame, keep: set[int]) -> DataFrame:
    """The rows of `votes` with `found`."""
    model = F.filter(F.col("_open"), lambda m: m["votes"].isin(*sorted(keep)) if keep else F.lit(False))
    return voted.withColumn("found", F.concat("base", S.tagged(model, "model", len(KINDS))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    voted = votes(base_spans(documents(spark, sf_dir).select("doc_id", "text")))
    # one scan of the texts: what it finds is written, without them
    voted = stage(voted.select("doc_id", *counts, "base", "_open", "_candidates"), "personal")
    out = with_model(voted, accepted(voted))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(S.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), S.joined(F.col("found")).alias("spans"))
