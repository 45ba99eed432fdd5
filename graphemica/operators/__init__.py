"""Operators on corpora: statistics, confusions, data sets and demappers."""
