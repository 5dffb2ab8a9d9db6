"""Spark jobs over evidence tables collected from many hosts."""
