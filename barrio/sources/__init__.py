"""Readers and writers of the engine's input and output files."""
