"""Governed business analytics as PySpark DataFrames.

Layers, bottom up:

* ``functions``  column expressions (cleaning, parsing, display, hashing)
* ``sources``    CSV and Parquet scans, the raw layer, run bookkeeping
* ``operators``  cleaning, metrics, insights, dashboards, question answering
* ``plans``      views over the test tables and the registered queries
"""
