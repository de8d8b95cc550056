"""Token-sequence patterns and their translation to Spark columns."""
