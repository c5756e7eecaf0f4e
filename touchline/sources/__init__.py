"""Files, and match-shaped views over order tables."""
