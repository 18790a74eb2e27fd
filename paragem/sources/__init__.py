"""Readers, writers and the derivation of plant tables from event tables."""
