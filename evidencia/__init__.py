"""evidencia: evidence analytics over DataFrames (text, claims, names, money, nested records)."""

__version__ = "0.1.0"
