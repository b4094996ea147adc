"""Operators on DataFrames: extraction, attribution, reports, rules, matching, rewriting, change sets."""
