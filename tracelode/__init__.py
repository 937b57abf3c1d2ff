"""tracelode: recordings of sampled signals as Spark tables, and operators over them."""

__version__ = "0.1.0"
