"""Toxicity: a factorisation machine over hashed terms: words and the stems of words."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import factorization as fm

PARAMS = fm.Params(structure=False, stems=(4, 5))


def train(docs: DataFrame, labels: DataFrame, params: fm.Params = PARAMS) -> fm.Model:
    """Learn from `labels` (doc_id, label; 1 is toxic), from the terms of the texts alone."""
    return fm.train(docs, labels, params)


def score(docs: DataFrame, model: fm.Model) -> DataFrame:
    """The documents with `score` (0 to 1, higher is more toxic); a column of that name is
    replaced.  A null or empty text has no terms and gets the score of none."""
    return fm.score(docs, model)
