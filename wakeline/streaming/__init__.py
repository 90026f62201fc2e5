"""Incremental forms: comment streams that are merged, scored and rolled up as they arrive."""
