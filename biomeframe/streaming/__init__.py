"""Models on streams of rows."""
