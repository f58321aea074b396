"""Spark-first engine for FITS files: scans, transforms, codecs, updates and writers as DataFrames."""
