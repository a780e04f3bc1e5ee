"""Reliability analytics for scored, labelled events, expressed as DataFrame-to-DataFrame functions."""
