"""Relational operators over tile runs, blobs and layers."""
