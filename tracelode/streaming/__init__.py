"""Recordings that arrive while a query runs."""
