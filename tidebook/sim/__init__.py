"""Closed-loop replay: a strategy's orders against recorded market data, one group per session and configuration."""

from .exchange import Settings
from .replay import book_samples, fills, order_events, replay, replay_stats
from .strategies import MicropriceMaker, Noop, OfiGatedMaker, SymmetricMaker

__all__ = ["Settings", "replay", "fills", "order_events", "book_samples", "replay_stats", "Noop", "SymmetricMaker", "MicropriceMaker", "OfiGatedMaker"]
