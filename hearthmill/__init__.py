"""hearthmill: a Spark-first engine for market-intelligence warehouses.

Sub-packages
------------
``functions``  column expressions (strings, dates, numbers, arrays, keys)
``operators``  relational and data-cleaning operators on DataFrames
``sources``    readers and generators
``plans``      model registry, table maintenance, snapshots, data tests
``streaming``  Structured Streaming ingestion
``queries``    named queries over the test tables, with their SQL
"""

__version__ = "0.1.0"
