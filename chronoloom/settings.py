"""Settings from the environment (``CHRONOLOOM_...``), and the engine's log."""

from __future__ import annotations

import functools
import json
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, fields

PREFIX = "CHRONOLOOM_"


@dataclass(frozen=True)
class Settings:
    """level: of the log; file: where it goes besides the console, if anywhere; as_json: one JSON object a line."""

    level: str = "INFO"
    file: str = ""
    as_json: bool = False

    @classmethod
    def from_environment(cls) -> Settings:
        found = {f.name: os.environ[PREFIX + f.name.upper()] for f in fields(cls) if PREFIX + f.name.upper() in os.environ}
        if "as_json" in found:
            found["as_json"] = found["as_json"].lower() in ("1", "true", "yes")
        return cls(**found)


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage(), **getattr(record, "more", {})})


def log(settings: Settings | None = None) -> logging.Logger:
    """The engine's logger, with handlers as the settings ask; it says nothing until this is called."""
    settings = settings or Settings.from_environment()
    logger = logging.getLogger("chronoloom")
    logger.handlers = [logging.StreamHandler(), *([logging.FileHandler(settings.file)] if settings.file else [])]
    for handler in logger.handlers:
        handler.setFormatter(_Json() if settings.as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logger.setLevel(settings.level)
    return logger


def traced(f: Callable) -> Callable:
    """Logs how long each call of ``f`` took on the driver (building plans, not running them), and its errors."""

    @functools.wraps(f)
    def run(*args, **options):
        began, logger = time.perf_counter(), logging.getLogger("chronoloom")
        try:
            out = f(*args, **options)
        except Exception as error:
            logger.error("%s: %s", f.__name__, error, extra={"more": {"error": type(error).__name__}})
            raise
        logger.debug("%s", f.__name__, extra={"more": {"seconds": round(time.perf_counter() - began, 4)}})
        return out

    return run
