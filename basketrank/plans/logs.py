"""Messages of experiments: to the console and, if asked for, to a file."""

from __future__ import annotations

import logging
import sys

NAME = "basketrank"


def setup_logging(file: str | None = None, console: str = "INFO", level: str = "DEBUG") -> logging.Logger:
    """One console handler and at most one file handler; calling again replaces them. Unknown levels raise."""
    log = logging.getLogger(NAME)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handlers = [(logging.StreamHandler(sys.stdout), console)] + ([(logging.FileHandler(file), level)] if file else [])
    for handler, least in handlers:
        handler.setLevel(least.upper())
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(min(handler.level for handler, _ in handlers))
    return log


def logger(part: str) -> logging.Logger:
    return logging.getLogger(f"{NAME}.{part}")
