"""Corpora, word lists, stored lexicons and exports."""
