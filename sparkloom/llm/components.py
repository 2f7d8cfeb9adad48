"""Connected components of the links among fingerprints: the library's star operations."""

from __future__ import annotations

from sparkloom.operators.graph import star_components as components

__all__ = ["components"]
