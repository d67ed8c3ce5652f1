"""pageloom: web-page analytics as Spark DataFrame transformations.

``functions``  column expressions (no shuffle, no Python)
``operators``  DataFrame -> DataFrame building blocks
``sources``    scans and sinks
``plans``      whole jobs users call
``streaming``  the same work on Structured Streaming
"""

__version__ = "0.1.0"
