"""functions of evidencia."""
