"""riskmart: consumer-credit risk analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    readers, sinks and the test-table adapter
functions  null-safe column helpers and rounding/format helpers
operators  rollups, features, validation, scorecard, decision, prep,
           metrics and MLlib model presets
plans      the registered queries and their DuckDB oracle SQL
streaming  the same scoring chain as a Structured Streaming job
"""

__version__ = "0.1.0"
