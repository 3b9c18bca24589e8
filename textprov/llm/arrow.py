"""The size of the batches that Python tasks see."""

from __future__ import annotations

from textprov.session import BATCH_BYTES, lean

__all__ = ["BATCH_BYTES", "lean"]
