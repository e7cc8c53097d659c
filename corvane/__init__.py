"""corvane: retrieval, ranking and evaluation over text corpora as Spark DataFrame jobs.

Functions that run inside tasks travel by value, so executors need the
third-party libraries but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

from corvane.config import RetrievalSettings, Settings
from corvane.errors import ConfigurationError, CorvaneError, DataFormatError, StoreError

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Names of the package, and the modules that they are loaded from when asked for.
_LATER = {
    "Engine": "corvane.plans.engine", "answer": "corvane.plans.engine", "corpus_of": "corvane.plans.engine", "retrieve": "corvane.plans.engine",
    "chunk_documents": "corvane.operators.chunking", "embed": "corvane.operators.embedding", "EmbeddingProvider": "corvane.operators.embedding",
    "rank": "corvane.operators.ranking", "fuse": "corvane.operators.ranking", "rerank_candidates": "corvane.operators.ranking",
    "model_rerank": "corvane.operators.rerank", "ingest": "corvane.operators.index", "ParquetStore": "corvane.operators.store", "Manifest": "corvane.operators.index",
    "evaluate": "corvane.operators.evaluation", "summary": "corvane.operators.evaluation", "leaderboard": "corvane.operators.evaluation",
    "cells": "corvane.plans.sweep", "read_documents": "corvane.sources.corpus", "read_gold": "corvane.sources.gold",
}

__all__ = ["ConfigurationError", "CorvaneError", "DataFormatError", "RetrievalSettings", "Settings", "StoreError", *_LATER]


def __getattr__(name: str):
    if name in _LATER:
        from importlib import import_module

        return getattr(import_module(_LATER[name]), name)
    raise AttributeError(f"corvane has no {name}")
