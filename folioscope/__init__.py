"""folioscope: document, terminology and ledger analytics expressed as Spark DataFrames."""

__version__ = "0.1.0"
