"""DataFrame operators: migration transforms, keys and ordering, relabelling."""

from .keys import dense_id, dense_id_nested, first_per_key, last_wins, position_in_group, rank_within
from .transforms import apply_log, expected_frame

__all__ = ["apply_log", "dense_id", "dense_id_nested", "expected_frame", "first_per_key", "last_wins",
           "position_in_group", "rank_within"]
