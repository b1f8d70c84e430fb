"""Reusable column expressions, the skew-safe top-k and checked semi joins."""

from .columns import in_window, item_key, non_blank, non_empty, render_arrays, ts_literal, windowed_rows
from .joins import Sized, as_frame, key_side, materialize, restrict_to
from .topk import top_k_per_group

__all__ = [
    "in_window", "item_key", "non_blank", "non_empty", "render_arrays", "ts_literal", "windowed_rows",
    "Sized", "as_frame", "key_side", "materialize", "restrict_to", "top_k_per_group",
]
