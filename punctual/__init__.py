"""Delivery punctuality analytics as plain Spark DataFrame operations.

Layout: ``functions`` holds Column expressions, ``sources`` reads and writes the two tables,
``operators`` holds the few multi-step DataFrame building blocks, ``plans`` holds the reports.
Every report is a function ``DataFrame -> DataFrame``; nothing runs until the caller acts on it.
"""
