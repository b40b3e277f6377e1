"""Disclosure-risk analytics over document tables, expressed as Spark plans."""
