"""Whole plans: the recording API and the registered queries."""
