"""Keyed state for streams."""

from tidefold.streaming.state import custom_stage, running_folds, with_previous

__all__ = ["custom_stage", "running_folds", "with_previous"]
