"""Continuous variants of the burst, budget and rate operators."""
