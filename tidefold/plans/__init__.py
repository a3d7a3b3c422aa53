"""Folds, lowering to window expressions, and pipelines (in ``plans.pipeline``)."""

from tidefold.plans.fold import Fold

__all__ = ["Fold"]
