"""operators of evidencia."""
