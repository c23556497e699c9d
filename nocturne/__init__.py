"""Batch and streaming analytics over keyed sensor logs, as PySpark jobs."""
