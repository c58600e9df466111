"""Structured Streaming jobs (weekly totals over arriving booking files)."""

from .weekly import read_booking_stream, start_weekly_totals, weekly_totals_stream  # noqa: F401
