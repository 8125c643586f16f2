"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import ann, decontaminate, packing, pii, quality, secret_scan, simhash, simhash_sql, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_approximate_nearest_neighbours": ann.query,
    "op3_secret_scans": secret_scan.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_suffix_array_dedup": suffix_dedup.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_packing": packing.query,
    "op9_toxicity": toxicity.query,
    "op10_pii": pii.query,
    "pipeline": corpus_pipeline.run,
}


def _runs(total: int, joint: str) -> str:
    """Tables that end in `windows` (doc_id, p, s, k): k is the hash of the `total` symbols from place p on, NULL where a text ends before."""
    joined, over = (f" || '{joint}' || " if joint else " || "), "OVER (PARTITION BY doc_id ORDER BY p)"
    out, size = ["r1 AS (SELECT doc_id, p, s, s AS c1 FROM symbols)"], 1
    while size * 2 <= total:
        out.append(f"r{size * 2} AS (SELECT *, c{size}{joined}lead(c{size}, {size}) {over} AS c{size * 2} FROM r{size})")
        size *= 2
    whole, at, k = f"c{size}", size, size
    while at < total:
        k //= 2
        if at + k <= total:
            whole += f"{joined}lead(c{k}, {at}) {over}"
            at += k
    return ", ".join([*out, f"windows AS (SELECT doc_id, p, s, md5({whole}) AS k FROM r{size})"])


def _covered(first: str, later: str, width: int) -> str:
    return f"""firsts AS (SELECT k, min({first}) AS first FROM windows WHERE k IS NOT NULL GROUP BY k),
  marked AS (SELECT w.*, coalesce({later}, false) AS again FROM windows w LEFT JOIN firsts USING (k)),
  covered AS (SELECT doc_id, p, s, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS {width - 1} PRECEDING) AS gone FROM marked)"""


_SYMBOLS = "symbols AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) - 1 AS p FROM (SELECT doc_id, {} AS w FROM documents))"
_WORDS = _SYMBOLS.format(r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')")
_BYTES = _SYMBOLS.format("regexp_extract_all(hex(encode(coalesce(text, ''))), '..')")
_PLACE = "doc_id::HUGEINT * 4294967296 + p"
#: Models, tokenizers and tilings are beyond the SQL of the oracle, as are spans that models add; tests use brute force instead.
ORACLES: dict[str, str] = {
    "op4_simhash_near_dedup": simhash_sql.oracle(),
    "op5_substring_dedup": f"""WITH {_WORDS}, {_runs(50, " ")}, {_covered("doc_id", "first < doc_id", 50)},
  found AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(s, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM covered GROUP BY 1)
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN found USING (doc_id)""",
    "op6_suffix_array_dedup": f"""WITH {_BYTES}, {_runs(100, "")}, {_covered(_PLACE, f"first < {_PLACE}", 100)},
  spans AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS opens FROM covered),
  found AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(s, '' ORDER BY p) FILTER (NOT gone) AS kept FROM spans GROUP BY 1)
  SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN found USING (doc_id)""",
}
