"""Plan-level helpers (lineage cuts, bounded broadcasts, global indexes) and
the registered query set."""

from .iterate import bounded_threshold, cut, dense_index, split_hub_join  # noqa: F401
