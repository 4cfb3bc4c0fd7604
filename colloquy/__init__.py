"""Colloquy: analytics over two-party conversation timelines, written for Spark.

Every operator takes and returns DataFrames; nothing is collected to the driver
except sizes that are bounded by construction (totals per source, counts per
partition, histograms).
"""
