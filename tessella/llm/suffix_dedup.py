"""Operator 6, suffix-array dedup: repeated byte strings by external induced sorting of shards.

Winnowed anchors deal the corpus into shards that hold every occurrence of the windows they own; contexts that are equal as
a whole are settled there, and one of each goes to the suffix sort of its shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, buffers, documents, groups, longs
from .induced import repeats
from .repeats import FEW, anchored, compare, contexts, cover, extend, with_repeats

OUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

RUNS = pa.schema([("doc_id", pa.int64()), ("at", pa.int64())])


def sorted_shards(rows: DataFrame, width: int, size: int = 2 << 20) -> DataFrame:
    """(doc_id, at) of the windows in `contexts` rows that repeat an earlier one; shards are whole anchors of about `size` bytes."""

    def found(batches):
        held, total = [], 0
        for batch, _ in groups(batches, ["a"]):
            more = batch.column("bytes").nbytes
            if held and total + more > size:
                yield sort(held)
                held, total = [], 0
            held.append(batch)
            total += more
        if held:
            yield sort(held)

    def sort(held):
        a, doc_id, at = (np.concatenate([longs(b.column(c)) for b in held]) for c in ("a", "doc_id", "at"))
        texts = [t for b in held for t in b.column("bytes").to_pylist()]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (doc_id[1:] != doc_id[:-1]) | (at[1:] != at[:-1])
        text, offset = repeats(texts, np.cumsum(new), width)
        order = np.lexsort((offset, text))
        text, offset = text[order], offset[order]
        first = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(offset) != 1))) if len(text) else text
        more = np.diff(np.append(first, len(text))) - 1
        run = text[first]
        return batch_of(RUNS, doc_id[run], (at[run] >> 24) + offset[first] << 24 | at[run] & 0xFFFF00 | more)

    ordered = rows.repartition("a").sortWithinPartitions("a", "doc_id", "at")
    return ordered.mapInArrow(found, "doc_id long, at long")


def suffix_dedup(docs: DataFrame, width: int = 100, gram: int = 28, few: int = FEW, texts: bool = True) -> DataFrame:
    """Removes bytes covered by a `width`-byte string that also starts earlier (smaller doc_id, or earlier in the document).

    Returns doc_id, kept (the remaining bytes; null unless `texts`), n_bytes, n_removed, n_spans, kept_sha256 for every row.
    A null text is empty; a row with a null doc_id loses nothing and removes nothing; repeated rows count as one document.
    An anchor with over `few` distinct contexts makes no shard: its windows are hashed one by one and spread over tasks.
    """
    found = anchored(docs, "byte", width, gram, True, few)
    more = sorted_shards(contexts(docs, found.filter("not same and not wide"), width), width)
    runs = found.filter("same").select("doc_id", "at").unionByName(more)
    wide = found.filter("wide")
    if not wide.isEmpty():
        runs = runs.unionByName(compare(extend(docs, wide, "byte", width), True).filter("same").select("doc_id", "at"))

    def finish(batches):
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            out = []
            for k, at in enumerate(batch.column("at_list")):
                own, removed, spans = data[offsets[k] : offsets[k + 1]], 0, 0
                n = len(own)
                if at.is_valid:
                    gone = cover(longs(at.values), n, width)
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    own = own[~gone]
                kept = own.tobytes()
                out.append((kept if texts else None, n, removed, spans, hashlib.sha256(kept).hexdigest()))
            yield batch_of(OUT, batch.column("doc_id"), *(list(zip(*out, strict=True)) or [[]] * 5))

    return with_repeats(docs, runs).mapInArrow(finish, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), texts=False).drop("kept")
