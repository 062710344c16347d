"""Readers of files and connectors to outside services."""
