"""Inputs: request lines, audio files, catalog, manifests."""
