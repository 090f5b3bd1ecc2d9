"""Operators for training-data pipelines. Nothing else in quarry imports this subpackage."""
