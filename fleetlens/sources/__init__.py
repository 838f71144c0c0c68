"""Readers for the text formats the fleet delivers."""
