"""Relational operators: classification, joins, binning, layer assembly and archive windows."""
