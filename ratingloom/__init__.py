"""Neighbourhood-based rating prediction as Spark DataFrame plans."""
