"""Relational operators of the pipeline, each a lazy DataFrame -> DataFrame function."""
