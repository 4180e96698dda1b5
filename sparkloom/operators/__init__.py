"""Registered queries, search and graph writes."""
