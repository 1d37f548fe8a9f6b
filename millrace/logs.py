"""Tagged logging of stages, and timing contexts whose durations become rows."""

from __future__ import annotations

import contextlib
import functools
import logging
import time
from collections.abc import Callable, Iterator

FORMAT = "%(asctime)s %(levelname)s [%(agent)s/%(step)s] %(message)s"


class _Tags(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.agent = getattr(record, "agent", "-")
        record.step = getattr(record, "step", "-")
        return True


def setup_logging(level: int = logging.INFO) -> logging.Logger:
    """The package's logger with one tagged handler, however often it is called."""
    log = logging.getLogger("millrace")
    if not any(getattr(h, "tagged", False) for h in log.handlers):
        handler = logging.StreamHandler()
        handler.tagged = True
        handler.addFilter(_Tags())
        handler.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(handler)
    log.setLevel(level)
    return log


class StageLog:
    """Logs for one agent; ``timings`` collects ``(kind, name, seconds)``."""

    def __init__(self, agent: str):
        self.agent, self.at, self.timings = agent, "-", []
        self.log = logging.getLogger(f"millrace.{agent}")

    def say(self, message: str, level: int = logging.INFO, *args) -> None:
        self.log.log(level, message, *args, extra={"agent": self.agent, "step": self.at})

    @contextlib.contextmanager
    def _timed(self, kind: str, name: str) -> Iterator[None]:
        before, self.at, began = self.at, name, time.time()
        self.say(f"{kind} begins")
        try:
            yield
            self.say(f"{kind} done in {time.time() - began:.2f} s")
        except Exception as e:
            self.say(f"{kind} failed after {time.time() - began:.2f} s: {e}", logging.ERROR)
            raise
        finally:
            self.timings.append((kind, name, round(time.time() - began, 2)))
            self.at = before

    def step(self, name: str):
        return self._timed("step", name)

    def phase(self, name: str):
        return self._timed("phase", name)


def logged(agent: str) -> Callable:
    """Decorator: a function as a timed phase of an agent."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **kwargs):
            with StageLog(agent).phase(f.__name__):
                return f(*args, **kwargs)

        return run

    return wrap
