"""Whole workflows: analyze, report, migrate."""
