"""Breakdown classifier, remaining-life regressor and their reports."""
