"""Lexical statistics on Spark: corpora in, a searchable lexicon out."""
