"""Readers of delimited, interval, sequence, alignment and variant text, and a writer that commits as a whole."""
