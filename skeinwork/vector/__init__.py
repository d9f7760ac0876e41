"""Vector of the engine."""
