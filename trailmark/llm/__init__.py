"""Operators for preparing large text corpora, each one a Spark job.

Nothing else in the library imports this subpackage.  ``queries`` binds the
operators to the synthetic tables; every other module is usable on its own.
"""
