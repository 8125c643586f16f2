"""Operator 5, substring dedup: seed and extend on winnowed word anchors."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, documents, longs
from .repeats import FEW, cover, repeated, with_repeats

OUT = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def substring_dedup(docs: DataFrame, words: int = 50, gram: int = 16, few: int = FEW, texts: bool = True) -> DataFrame:
    """Removes words of passages of `words` words or more that also stand in a document with a smaller doc_id.

    Words are maximal runs outside space, tab, newline, \\x0B, \\f and \\r. Documents seed on the winnowed `gram`-word
    anchors of their windows; equal anchors are extended both ways, first as whole contexts, then window by window, so
    every repeated window is found and the union of windows is the maximal repeat. Returns doc_id, kept_text (null unless
    `texts`), n_words, n_removed, kept_sha256 for every row. A null text has no words; a row with a null doc_id loses
    nothing and removes nothing; repeated rows count as one document.
    """
    runs = repeated(docs, "word", words, gram, False, few)

    def finish(batches):
        for batch in batches:
            out = []
            for text, at in zip(batch.column("text"), batch.column("at_list"), strict=True):
                own = (text.as_py() or "").encode().split()
                n, removed = len(own), 0
                if at.is_valid:
                    gone = cover(longs(at.values), n, words)
                    removed = int(gone.sum())
                    own = list(compress(own, ~gone))
                kept = b" ".join(own)
                out.append((kept.decode() if texts else None, n, removed, hashlib.sha256(kept).hexdigest()))
            yield batch_of(OUT, batch.column("doc_id"), *(list(zip(*out, strict=True)) or [[]] * 4))

    return with_repeats(docs, runs).mapInArrow(finish, "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), texts=False).drop("kept_text")
