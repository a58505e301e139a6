"""Evaluation of time-windowed, multi-class detectors as Spark DataFrame operators."""
