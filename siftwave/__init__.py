"""Condition monitoring of multichannel machine recordings as Spark DataFrame plans."""
