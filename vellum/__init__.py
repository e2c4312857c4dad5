"""Spark-native analytics over auditable evidence collections.

Every public function takes and returns DataFrames, builds its plan lazily and leaves the
physical strategy to Catalyst and adaptive execution.  Nothing here imports ``vellum.llm``.
"""

__version__ = "0.1.0"
