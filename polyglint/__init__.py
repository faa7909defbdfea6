"""Audits of translation catalogs as Spark DataFrame operators."""
