"""lakeloom: a Spark-first lakehouse analytics engine.

Sub-packages: ``sources`` (readers, writers, files), ``functions`` (column
helpers with PostgreSQL semantics), ``operators`` (relational and data-pipeline
operators), ``table`` (snapshot table layer), ``plans`` (plan inspection),
``streaming`` and ``queries`` (registered queries with their oracle SQL).
"""

__version__ = "0.1.0"
