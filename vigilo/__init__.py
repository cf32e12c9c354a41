"""vigilo — transaction-risk analytics on Spark DataFrames.

Sub-packages
------------
sources    table readers, the two transaction adapters, file sinks, JSON payloads
functions  column-expression builders (cleaning, features, text, bands)
operators  set-at-a-time operators (historical windows, profiling, metrics,
           joins, ordering, queue/feedback, ML)
streaming  the stateful scoring stream and its event-time twins
plans      the registered queries and their DuckDB oracle SQL
"""

__all__ = ["session"]
