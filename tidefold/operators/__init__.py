"""Operators on ordered records, and their composition."""

from tidefold.operators.ops import (
    Custom,
    DedupBy,
    Delta,
    Filter,
    FilterMap,
    FlatMap,
    Inspect,
    Latency,
    Latest,
    Map,
    Operator,
    Progress,
    Stateful,
    TrackPrev,
    compose,
)

__all__ = [
    "Custom",
    "DedupBy",
    "Delta",
    "Filter",
    "FilterMap",
    "FlatMap",
    "Inspect",
    "Latency",
    "Latest",
    "Map",
    "Operator",
    "Progress",
    "Stateful",
    "TrackPrev",
    "compose",
]
