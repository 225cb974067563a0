"""Operators of a training-data pipeline. Nothing else in cairnlake imports this subpackage."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable

from pyspark import cloudpickle

# Executors get this subpackage's functions with the job; it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Query -> module; each module holds a function of the query's name, and ORACLE if SQL can express it.
MODULES = {
    "op1_media": "media",
    "op2_ann": "ann",
    "op3_license": "license_scan",
    "op4_jaccard": "jaccard",
    "op5_sentencepiece": "pieces",
    "op6_mixing": "mixing",
    "op7_pii": "pii",
    "op8_quality": "quality",
    "op9_url_filter": "url_filter",
    "op10_tokens": "token_files",
    "op11_clusters": "clusters",
    "op12_resampling": "resampling",
    "op13_near_vectors": "near_vectors",
}


def queries() -> dict[str, Callable]:
    return {q: getattr(importlib.import_module(f"{__name__}.{m}"), q) for q, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {q: getattr(importlib.import_module(f"{__name__}.{m}"), "ORACLE", None) for q, m in MODULES.items()}
    return {q: sql for q, sql in found.items() if sql}
