"""Recordings on disk, wire streams, sidecars, telemetry and configuration."""
