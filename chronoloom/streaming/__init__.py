"""Roll-ups of streams."""

from chronoloom.streaming.rollup import streamed

__all__ = ["streamed"]
