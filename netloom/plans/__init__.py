"""Test captures made from tables, and the registered queries."""
