"""Operators of a training-data pipeline. Nothing else in siftlake imports this subpackage."""
