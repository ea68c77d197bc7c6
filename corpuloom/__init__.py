"""Corpuloom: preparing and evaluating language-model corpora on Spark."""
