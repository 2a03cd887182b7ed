"""Registered queries over the adapter views."""

from . import checks_q, live_q, more_q, replay_q, reports_q, runs_q, signals_q, stats_q, streams_q  # noqa: F401
