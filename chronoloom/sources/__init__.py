"""Reading panels of series from files."""

from chronoloom.sources.panels import as_frames, first_series, read_panel

__all__ = ["as_frames", "first_series", "read_panel"]
