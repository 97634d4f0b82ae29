"""Groundwork: table-to-table PySpark jobs over collections of captured text."""
