"""Log lines as JSON or text."""

from __future__ import annotations

import json
import logging
import sys


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S%z"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line | getattr(record, "fields", {}))


def logger(name: str = "vicinal", level: str = "info", form: str = "json") -> logging.Logger:
    """A logger to standard error; an unknown level is info. Fields go in ``extra={"fields": {...}}``."""
    out = logging.getLogger(name)
    out.setLevel(getattr(logging, level.upper(), logging.INFO))
    out.handlers.clear()
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if form == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    out.addHandler(handler)
    return out
