"""textloom: deterministic document screening and corpus preparation on Spark."""

__version__ = "0.1.0"
