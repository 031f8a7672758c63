"""Whole builds made of several operators."""
