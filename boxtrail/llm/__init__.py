"""Operators of a training-data pipeline: token counts, quality, decontamination, scoring, deduplication, scans."""
