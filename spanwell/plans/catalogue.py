"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from ..operators import cards, checks, evaluation, evidence, features, folds, integrity, memory, selection, training
from ..sources import adapters
from ..streaming import windows
from . import oracles
from .dialect import oracle, query

_PLANS = {**selection.PLANS, **evaluation.PLANS, **integrity.PLANS, **evidence.PLANS, **cards.PLANS, **checks.PLANS, **training.PLANS}

QUERIES = {name: query(plan) for name, plan in _PLANS.items()}
ORACLE_SQL = {name: oracle(plan) for name, plan in _PLANS.items()}

_FOLDS = {**folds.FOLDS, "structured_memory": memory.StructuredMemory}
_VECTOR_FOLDS = {"semantic_reservoir", "hierarchical_events", "structured_memory"}


def _fold(name):
    def run(spark, sf_dir):
        source = adapters.vector_frames(spark, sf_dir) if name in _VECTOR_FOLDS else adapters.frames(spark, sf_dir)
        return folds.run_fold(source, _FOLDS[name]())

    return run


QUERIES |= {name: _fold(name) for name in _FOLDS}
QUERIES |= {
    "temporal_nms": lambda s, d: folds.temporal_nms(adapters.evals(s, d).select("query_id", "candidate", "pred_start", "pred_end", "score")),
    "mmr_select": lambda s, d: folds.mmr_select(adapters.vector_frames(s, d)),
    "cell_tokens": lambda s, d: features.cell_summary(adapters.vector_frames(s, d)),
    "cell_change": lambda s, d: features.cell_change(adapters.vector_frames(s, d)),
    "offset_scores": lambda s, d: features.offset_scores(adapters.scored(s, d)),
    "quantized_vectors": lambda s, d: features.quantized(adapters.table(s, d, "embeddings")),
    "ridge_fit": lambda s, d: features.ridge_table(adapters.table(s, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"),
    "cross_fit_errors": lambda s, d: features.cross_fit_errors(adapters.evals(s, d)),
}
QUERIES |= windows.QUERIES
ORACLE_SQL |= oracles.ORACLE_SQL
