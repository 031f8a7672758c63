"""Morphological features: which ones a language keeps, and their column names."""

from __future__ import annotations

# Universal Dependencies feature name -> lexicon column name.
FEATURE_COLUMNS = {
    "Number": "nnumber",
    "Case": "nouncase",
    "Gender": "gender",
    "Definite": "definite",
    "Mood": "mood",
    "Tense": "tense",
    "Aspect": "aspect",
    "Voice": "voice",
    "Person": "person",
    "VerbForm": "verbform",
    "PartForm": "partform",
    "Degree": "degree",
    "Person[psor]": "posspers",
    "Number[psor]": "possnum",
    "Poss": "poss",
    "Clitic": "clitic",
    "Derivation": "derivation",
    "Style": "style",
    "Typo": "typo",
}

# The columns each language keeps, in table order.
LANGUAGE_COLUMNS = {
    "fi": ["nouncase", "nnumber", "mood", "tense", "voice", "person", "verbform",
           "clitic", "derivation", "posspers", "possnum"],
    "es": ["nouncase", "nnumber", "gender", "definite", "mood", "tense", "voice",
           "person", "verbform", "possnum"],
    "pt": ["nouncase", "nnumber", "gender", "definite", "mood", "tense", "voice",
           "person", "verbform", "possnum"],
    "sv": ["nouncase", "nnumber", "gender", "definite", "mood", "tense", "voice",
           "person", "verbform"],
}

# Language names stored with the code.
LANGUAGE_NAMES = {"fi": "Finnish", "es": "Spanish", "pt": "Portuguese", "sv": "Swedish"}

# Features that may hold several comma-separated values, searched value by value.
MULTI_VALUE_COLUMNS = ("derivation", "clitic")

DEFAULT_LANGUAGE = "fi"


def features_for(langcode: str | None = None) -> dict[str, str]:
    """Core features of a language as {UD name: column}, in table order.

    A language without a list of its own uses the Finnish one.
    """
    columns = LANGUAGE_COLUMNS.get((langcode or DEFAULT_LANGUAGE).lower(),
                                   LANGUAGE_COLUMNS[DEFAULT_LANGUAGE])
    ud_name = {column: name for name, column in FEATURE_COLUMNS.items()}
    return {ud_name[column]: column for column in columns}


def metadata_for(langcode: str) -> dict[str, str]:
    """The key/value pairs stored with a lexicon."""
    return {"language": LANGUAGE_NAMES.get(langcode, langcode), "langcode": langcode}
