"""Spark-native analytics over pairs of token sequences: features, alignments, training and evaluation."""

__version__ = "0.1.0"
