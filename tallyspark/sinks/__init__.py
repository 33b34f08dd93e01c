"""Durable writes."""
