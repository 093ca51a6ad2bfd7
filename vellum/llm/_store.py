"""Tables that an operator writes between its steps, in the folder the cluster shares."""

from __future__ import annotations

from vellum.sources.scratch import Scratch, small

__all__ = ["Scratch", "small"]
