"""fusionweft: profile fusion and corpus preparation as declarative Spark plans."""

__version__ = "1.0.0"
