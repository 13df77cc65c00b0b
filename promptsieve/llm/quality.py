"""Quality classifier: a factorisation machine on hashed words, structure and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import factorization as fm

PARAMS = fm.Params()


def train(docs: DataFrame, labels: DataFrame, params: fm.Params = PARAMS) -> fm.Model:
    """Learn from `labels` (doc_id, label; 1 is good).  Never reads lang, source or doc_id
    as an input; metadata is n_chars alone."""
    return fm.train(docs, labels, params)


def score(docs: DataFrame, model: fm.Model) -> DataFrame:
    """The documents with `score` (0 to 1, higher is better); a column of that name is replaced.

    A null or empty text has no words: its score follows from its statistics and n_chars,
    where a null has a bin of its own.  Repeated rows score alike.
    """
    return fm.score(docs, model)
