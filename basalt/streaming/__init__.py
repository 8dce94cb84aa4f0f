"""Plans over unbounded sources."""

from .incremental import run_on_batches

__all__ = ["run_on_batches"]
