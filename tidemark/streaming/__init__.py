"""Replay of captures as streams."""
