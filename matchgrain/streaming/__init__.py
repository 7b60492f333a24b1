"""Streams of feeds that refresh tables batch by batch."""
