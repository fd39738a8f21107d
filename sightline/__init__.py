"""Spark-first analytics over camera detections, event logs and text corpora."""
