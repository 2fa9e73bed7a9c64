"""Longitudinal connectome analytics as PySpark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  ``functions`` holds
column expressions, ``operators`` the relational and statistical steps,
``sources`` the scans and sinks, ``streaming`` the incremental (only-new-work)
steps and ``plans`` the registered queries with their SQL counterparts.
"""

__version__ = "0.1.0"
