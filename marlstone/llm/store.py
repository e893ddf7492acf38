"""Tables written to the shared checkpoint folder, which cut lineage and survive lost executors."""

from __future__ import annotations

from ..session import scratch as folder
from ..session import shipped
from ..sources.stage import dropped, saved, settled, swept

__all__ = ["dropped", "folder", "saved", "settled", "shipped", "swept"]
