"""SQL fragments and scalar and aggregate primitives."""
