"""Log lines as JSON, one object a line, with fields of their own beside the message."""

from __future__ import annotations

import json
import logging


class JsonLines(logging.Formatter):
    """ts, level, logger and msg, then the fields given as ``extra={"fields": {...}}``."""

    def format(self, record: logging.LogRecord) -> str:
        said = {"ts": self.formatTime(record), "level": record.levelname, "logger": record.name, "msg": record.getMessage()}
        return json.dumps(said | (getattr(record, "fields", None) or {}), default=str, ensure_ascii=False)


class EventLogger(logging.LoggerAdapter):
    """``log.info("bar processed", bar_idx=42, tf="5m")``: keyword arguments become fields."""

    def process(self, msg: str, kwargs: dict) -> tuple[str, dict]:
        known = {k: kwargs.pop(k) for k in ("exc_info", "stack_info", "stacklevel") if k in kwargs}
        return msg, known | {"extra": {"fields": dict(kwargs)}}


def event_logger(name: str, handler: logging.Handler | None = None) -> EventLogger:
    """A logger of JSON lines; its handler is added once."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        handler = handler or logging.StreamHandler()
        handler.setFormatter(JsonLines())
        logger.addHandler(handler)
        logger.setLevel(logging.DEBUG)
    return EventLogger(logger, {})
