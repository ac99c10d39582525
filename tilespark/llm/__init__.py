"""Operators for building language-model training corpora (independent of the map side of the library)."""
