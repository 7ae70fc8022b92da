"""Readers of linguistic resources, Unicode tables and model files."""
