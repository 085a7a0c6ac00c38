"""Stateful operators over streams of wire records, and their batch twins."""
