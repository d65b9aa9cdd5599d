"""Readers and writers for the tables of facts."""
