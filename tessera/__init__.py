"""tessera: evidence analytics over heterogeneous tables, declared as Spark plans."""

__version__ = "0.1.0"
