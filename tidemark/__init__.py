"""tidemark: change-point, market-state and event-time analytics on Spark DataFrames.

Long tables ``(symbol, ts, value)`` or ``(symbol, ts, open, high, low, close)``
go in, DataFrames come out.  Relational work is left to Catalyst; recurrences
that are sequential within a series run as single-pass kernels, one series per
task, shared between batch and Structured Streaming.
"""

__version__ = "0.1.0"
