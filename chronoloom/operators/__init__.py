"""Operators over frames, blocks, ledgers and logs."""
