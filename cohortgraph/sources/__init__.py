"""Input readers (rank_scores, activity), the storage layout, and the driver-table fixture mapping."""

from .fixtures import fixture_activity, fixture_config, fixture_inputs, fixture_scores
from .tables import (normalise_activity, normalise_scores, read_activity, read_scores, register_inputs,
                     write_activity, write_scores)

__all__ = [
    "fixture_activity", "fixture_config", "fixture_inputs", "fixture_scores",
    "normalise_activity", "normalise_scores", "read_activity", "read_scores", "register_inputs",
    "write_activity", "write_scores",
]
