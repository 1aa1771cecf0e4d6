"""Splits, scaling, nearest neighbours, detection, classification, evaluation, signals."""
