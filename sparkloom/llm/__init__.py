"""Operators for preparing training text at scale.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only if the package is present.
"""
