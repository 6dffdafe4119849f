"""Logging of the driver's side, as text or as one JSON object a line."""

from __future__ import annotations

import json
import logging
import sys


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": self.formatTime(record), "level": record.levelname, "module": record.module, "message": record.getMessage()}
        return json.dumps(line | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}), ensure_ascii=False)


def set_up(level: str = "info", form: str = "text", stream=None) -> logging.Logger:
    """The package's logger, writing to stream (default: standard output); an unknown level is info. Calling it again replaces the handler."""
    logger = logging.getLogger("wordshield")
    handler = logging.StreamHandler(stream or sys.stdout)
    handler.setFormatter(JsonLines() if form == "json" else logging.Formatter("%(asctime)s [%(levelname)s] %(module)s: %(message)s"))
    logger.handlers[:] = [handler]
    logger.setLevel(logging.getLevelNamesMapping().get(level.upper(), logging.INFO))
    return logger
