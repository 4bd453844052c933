"""factloom: mining, describing and scoring facts in large corpora of tables, as Spark DataFrame jobs."""

from factloom.keyed import KeyedTable

__all__ = ["KeyedTable"]
