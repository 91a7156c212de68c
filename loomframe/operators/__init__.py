"""Operators that Spark has no single plan for, composed from its own."""

from loomframe.operators.asof import asof
from loomframe.operators.funnels import funnel
from loomframe.operators.joins import asof_join, interval_join, not_in, salted_join
from loomframe.operators.overlaps import overlap_join
from loomframe.operators.patterns import match_rows
from loomframe.operators.recursion import closure, distances, fixpoint, hierarchy
from loomframe.operators.selection import quantiles
from loomframe.operators.series import gap_fill, sessionize, windowed
from loomframe.operators.windows import frame_excluding, groups_frame, qualify, ranked, top_k

__all__ = [
    "asof", "asof_join", "closure", "distances", "fixpoint", "frame_excluding", "funnel", "gap_fill", "groups_frame", "hierarchy", "interval_join", "match_rows",
    "not_in", "overlap_join", "qualify", "quantiles", "ranked", "salted_join", "sessionize", "top_k", "windowed",
]
