"""DuckDB SQL of operator 4: XXH64 written out, fingerprints and components, for the oracle only."""

from __future__ import annotations

#: The constants of XXH64 (fixed values).
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
P1, P2, P3, P4, P5 = PRIMES
WORD = 1 << 64


def _cut(e: str) -> str:
    return f"(({e}) % {WORD}::UHUGEINT)::UBIGINT"


def _times(a: str, p: int) -> str:
    return _cut(f"({a})::UHUGEINT * {p}::UHUGEINT")


def _plus(a: str, b: str | int) -> str:
    return _cut(f"({a})::UHUGEINT + ({b})::UHUGEINT")


def _turned(x: str, r: int) -> str:
    return _cut(f"({x})::UHUGEINT * {1 << r}::UHUGEINT + (({x}) >> {64 - r})::UHUGEINT")


def _lane(at: str, n: int) -> str:
    """n bytes from byte `at` of the hexadecimal text h, the lowest first."""
    return "('0x' || " + " || ".join(f"substr(h, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT"


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_plus(acc, _times(lane, P2)), 31), P1)


def _folded(start: str, count: str, lane: str, step: str) -> str:
    """`step` of (a, l) over the lanes i = 0, 1, ..."""
    return f"list_reduce(list_prepend(({start})::UBIGINT, list_transform(range({count}), lambda i: {lane})), lambda a, l: {step})"


def xxh64(seed: int) -> str:
    """Tables from `grams` (g) to `hashed` (g, x), x the XXH64 of the UTF-8 bytes of each distinct g."""
    starts = [(seed + P1 + P2) % WORD, (seed + P2) % WORD, seed, (seed - P1) % WORD]
    lanes = ", ".join(f"CASE WHEN n >= 32 THEN {_folded(f'{v}::UBIGINT', 'n // 32', _lane(f'32 * i + {8 * k}', 8), _round('a', 'l'))} END AS v{k}" for k, v in enumerate(starts))
    joined = _cut(" + ".join(f"({_turned(f'v{k}', r)})::UHUGEINT" for k, r in enumerate((1, 7, 12, 18))))
    merged = ", ".join(
        f"m{k} AS (SELECT * REPLACE (CASE WHEN n >= 32 THEN {_plus(_times(f'xor(acc, {_round("0::UBIGINT", f"v{k}")})', P1), P4)} ELSE acc END AS acc) FROM {f'm{k - 1}' if k else 's2'})" for k in range(4)
    )
    eights = _folded("acc", "(n % 32) // 8", _lane("n - n % 32 + 8 * i", 8), _plus(_times(_turned(f"xor(a, {_round('0::UBIGINT', 'l')})", 27), P1), P4))
    four = _plus(_times(_turned(f"xor(acc, {_times(_lane('n - n % 8', 4), P1)})", 23), P2), P3)
    ones = _folded("acc", "n % 4", _lane("n - n % 4 + i", 1), _times(_turned(f"xor(a, {_times('l', P5)})", 11), P1))
    return f"""s0 AS (SELECT DISTINCT g, hex(encode(g)) AS h, octet_length(encode(g)) AS n FROM grams),
  s1 AS (SELECT *, {lanes} FROM s0), s2 AS (SELECT *, CASE WHEN n >= 32 THEN {joined} ELSE {(seed + P5) % WORD}::UBIGINT END AS acc FROM s1),
  {merged}, s3 AS (SELECT g, h, n, {_plus("acc", "n")} AS acc FROM m3), s4 AS (SELECT g, h, n, {eights} AS acc FROM s3),
  s5 AS (SELECT g, h, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE acc END AS acc FROM s4), s6 AS (SELECT g, {ones} AS acc FROM s5),
  s7 AS (SELECT g, {_times("xor(acc, acc >> 33)", P2)} AS acc FROM s6), s8 AS (SELECT g, {_times("xor(acc, acc >> 29)", P3)} AS acc FROM s7),
  hashed AS (SELECT g, xor(acc, acc >> 32) AS x FROM s8)"""


def oracle(words: int = 3, bits: int = 3, seed: int = 42) -> str:
    """The rows of `simhash.near_duplicates` over `documents`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = "s" + "".join(f" || coalesce(' ' || lead(s, {k}) OVER o, '')" for k in range(1, words))
    votes = _cut(" + ".join(f"(CASE WHEN 2 * sum((x >> {b}) & 1) > count(x) THEN {1 << b}::UHUGEINT ELSE 0 END)::UHUGEINT" for b in range(64)))
    return rf"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  placed AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS p, len(w) AS c FROM texts),
  grams AS (SELECT doc_id, {gram} AS g, p, c FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY p) QUALIFY p <= greatest(c - {words - 1}, 1)),
  {xxh64(seed)},
  prints AS (SELECT doc_id, coalesce(f, 0)::UBIGINT AS f FROM documents LEFT JOIN (SELECT doc_id, {votes} AS f FROM grams JOIN hashed USING (g) GROUP BY 1) USING (doc_id)),
  classes AS (SELECT f, min(doc_id) AS rep FROM prints GROUP BY 1),
  edges AS (SELECT a.rep AS u, b.rep AS v FROM classes a, classes b WHERE a.rep <> b.rep AND bit_count(xor(a.f, b.f)) <= {bits}),
  reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u),
  roots AS (SELECT a, min(b) AS root FROM reach GROUP BY 1)
  SELECT doc_id, lower(lpad(hex(f), 16, '0')) AS fingerprint, root AS component_id FROM prints JOIN classes USING (f) JOIN roots ON rep = a"""
