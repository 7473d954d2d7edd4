"""Group-time average treatment effects and related panel operators on Spark DataFrames.

``ATTgt``, ``load_data`` (readers for the usual example tables) and ``simulate_data`` are the public names.
"""

from __future__ import annotations

__all__ = ["ATTgt", "load_data", "simulate_data"]


def __getattr__(name: str) -> object:
    # looked up on first use: executors that only need another part import nothing of these
    if name == "ATTgt":
        from .plans.attgt import ATTgt

        return ATTgt
    if name == "load_data":
        from .sources import loaders

        return loaders
    if name == "simulate_data":
        from .sources.simulate import simulate_data

        return simulate_data
    raise AttributeError(name)
