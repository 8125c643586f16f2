"""Operator 3, secret scans: fixed formats, and character Markov models of random strings against identifiers. JVM only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import documents, stage, unstage

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SIZE = len(ALPHABET) + 1
#: Fixed formats: a keyword and its value, an access key, a long hexadecimal run.
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = "^" + KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models judge: runs of this many characters or more, whatever they are made of.
LEAST = 12
RUN = "[A-Za-z0-9+/_=-]"
TOKEN = rf"(?<!{RUN}){RUN}{{{LEAST},}}"


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio of each bigram, random against ordinary (SIZE * SIZE numbers), and the sum from which a run counts as random."""

    ratios: list[float]
    threshold: float

    def score(self, token: Column) -> Column:
        table = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")
        return F.aggregate(_bigrams(token), F.lit(0.0), lambda total, code: total + F.element_at(table, code.cast("int") + 1))


def _bigrams(token: Column) -> Column:
    """Code of each two neighbouring characters of a token over ALPHABET (others share code 0)."""
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda k: F.instr(F.lit(ALPHABET), F.substring(token, k, F.lit(1))) * SIZE + F.instr(F.lit(ALPHABET), F.substring(token, k + 1, F.lit(1))))


def _samples(docs: DataFrame, sample: int, random: int) -> DataFrame:
    """(token, y): random strings are 1, the ordinary runs of 8 characters or more in whole texts of `sample` documents are 0."""
    key = F.sha2(F.col("id").cast("string"), 256)
    digest = F.base64(F.unhex(key))
    forms = [F.substring(key, 1, 40), F.substring(F.translate(digest, "=", ""), 1, 40), F.substring(F.upper(F.translate(digest, "+/=", "XQ")), 5, 24), F.substring(F.translate(digest, "+/=0123456789", ""), 1, 24)]
    made = docs.sparkSession.range(random).select(F.explode(F.array(*forms)).alias("token"), F.lit(1).alias("y"))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    words = docs.join(F.broadcast(ids), "doc_id").select(F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{8,}}"), F.lit(0))).alias("token"), F.lit(0).alias("y"))
    return made.unionByName(words)


def train(docs: DataFrame, sample: int = 2000, random: int = 3000, smooth: float = 0.5, margin: float = 2.0) -> Markov:
    """Both models' bigrams from three quarters of the labelled samples, and a threshold `margin` above all ordinary runs of the rest.

    Labelled samples: generated strings (hex, base64, upper case with digits, letters alone) and ordinary runs, those outside
    fixed-format matches in the whole texts of at most `sample` documents chosen by a hash of the id. Null ids and null
    texts teach nothing; repeated rows count as often as they stand there. Without ordinary runs the threshold is 10.
    """
    tokens = stage(_samples(docs.select("doc_id", "text"), sample, random).withColumn("rest", F.pmod(F.xxhash64("token"), F.lit(4)) == 0), "secret-samples")
    pairs = tokens.filter("not rest").select("y", F.explode(_bigrams(F.col("token"))).alias("code"))
    seen = {(r.y, r.code): r["count"] for r in pairs.groupBy("y", "code").count().collect()}  # 2 * SIZE**2 rows at most
    out = []
    totals = [[sum(seen.get((y, a * SIZE + b), 0) for b in range(SIZE)) + smooth * SIZE for a in range(SIZE)] for y in (0, 1)]
    for a in range(SIZE):
        for b in range(SIZE):
            p = [(seen.get((y, a * SIZE + b), 0) + smooth) / totals[y][a] for y in (0, 1)]
            out.append(round(math.log(p[1] / p[0]), 4))
    model = Markov(out, 0.0)
    ordinary = tokens.filter(F.col("rest") & (F.col("y") == 0) & (F.length("token") >= LEAST))
    most = ordinary.agg(F.max(model.score(F.col("token"))).alias("most")).first().most
    unstage(tokens)
    return Markov(out, 10.0 if most is None else max(0.0, most) + margin)


def scan(docs: DataFrame, model: Markov) -> DataFrame:
    """All columns of `docs` with `base` and `found`: arrays of (start, rank, end, kind), found holding base and model spans.

    A run of LEAST characters or more is a model span ("markov") if its log-likelihood ratio reaches the threshold and it
    overlaps no base span. Both are sorted by start, then kind. A null text is empty; repeated rows and null ids are scanned like any
    other. Columns of `docs` with the names of these results or with an underscored kind are replaced.
    """
    docs = docs.drop("base", "found", "_assign", "_access", "_hex", "_token")
    raw = F.coalesce(F.col("text"), F.lit(""))
    when = lambda has, spans: F.when(has, spans).otherwise(S.none())
    text = S.plain(raw)
    # {6,}: a value of fewer characters fails; its match is consumed either way
    assign = F.filter(S.find(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], VALUE, 1)) >= 6)
    found = docs.select(
        "*",
        when(raw.rlike(KEYWORD + r"""["']?\x20*[:=]"""), assign).alias("_assign"),
        when(raw.contains("AKIA"), S.find(text, ACCESS)).alias("_access"),
        when(raw.rlike(r"(?<![0-9a-f])[0-9a-f]{24}"), S.find(text, HEX)).alias("_hex"),
        when(raw.rlike(TOKEN), F.filter(S.find(text, TOKEN), lambda m: model.score(m["value"]) >= model.threshold)).alias("_token"),
    )
    base = F.array_sort(F.concat(*(S.tagged(F.col(f"_{k}"), k, n) for n, k in enumerate(("assign", "access", "hex")))))
    more = S.tagged(S.apart(F.col("_token"), F.col("base")), "markov", 3)
    out = found.withColumn("base", base)
    return out.withColumn("found", F.array_sort(F.concat("base", more)))


def redact(docs: DataFrame, model: Markov, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its texts replaced by `mask`; overlapping spans are replaced together. Null stays null."""
    out = scan(docs.select("text", F.struct("*").alias("row")), model)
    return out.withColumn("text", S.masked(F.col("text"), F.col("found"), mask)).select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scan(docs, train(docs))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(S.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), S.joined(F.col("found")).alias("spans"))
