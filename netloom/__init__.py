"""Packet-capture analytics as Spark DataFrame transformations."""
