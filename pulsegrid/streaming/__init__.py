"""Streaming drivers."""
