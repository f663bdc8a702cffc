"""Timing of public operations: one event per outermost call, above a threshold, to a listener that can't break the call."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass


@dataclass(frozen=True)
class Event:
    operation: str
    seconds: float
    failed: bool
    error: str | None = None


_listener: ContextVar[tuple[Callable[[Event], None], float] | None] = ContextVar("listener", default=None)
_depth: ContextVar[int] = ContextVar("depth", default=0)


def listen(listener: Callable[[Event], None] | None, least_seconds: float = 0.0) -> None:
    _listener.set((listener, least_seconds) if listener else None)


def traced(f):
    """Calls within a traced call aren't told; a failing call is, and its error goes on."""

    @functools.wraps(f)
    def wrapper(*args, **kwargs):
        if _depth.get() or _listener.get() is None:
            return f(*args, **kwargs)
        token, began, error = _depth.set(1), time.perf_counter(), None
        try:
            return f(*args, **kwargs)
        except BaseException as e:
            error = getattr(e, "code", type(e).__name__)
            raise
        finally:
            _depth.reset(token)
            heard, least = _listener.get()
            seconds = time.perf_counter() - began
            if seconds >= least:
                try:
                    heard(Event(f.__name__, seconds, error is not None, error))
                except Exception:  # a listener's own failure isn't the operation's
                    pass

    return wrapper
