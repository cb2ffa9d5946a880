"""Anonymise tables with Spark: profile, classify, configure, mask, write, validate."""
