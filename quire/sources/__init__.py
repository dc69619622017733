"""Readers and exports."""
