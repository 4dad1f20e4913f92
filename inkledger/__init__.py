"""Scan-inventory analytics on Spark.

Sub-packages: ``functions`` (Column expressions), ``sources`` (readers and
sinks), ``operators`` (DataFrame -> DataFrame steps), ``plans`` (whole
workflows) and ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
