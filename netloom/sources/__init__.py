"""Readers of captures and key logs."""
