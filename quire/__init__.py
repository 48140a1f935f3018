"""Catalogue analytics on PySpark: statistics, duplicate detection, repair, classification and text pipelines."""
