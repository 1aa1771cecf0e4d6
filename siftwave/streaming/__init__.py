"""Scoring of arriving samples against a fixed reference set."""
