"""Settings with a prefix per application, and values given as words."""

from __future__ import annotations

import os
import random
import time
from collections.abc import Callable, Mapping
from functools import wraps

from pyspark.sql import SparkSession

# The words that count as true and false.
TRUE = frozenset("y yes t true on 1".split())
FALSE = frozenset("n no f false off 0".split())


def strtobool(value: str) -> bool:
    if not isinstance(value, str):
        raise TypeError(f"{value!r} is not a string")
    word = value.lower()
    if word in TRUE:
        return True
    if word in FALSE:
        return False
    raise ValueError(f"{value!r} is neither true nor false")


class Settings:
    """KEY for an application NAME is NAME_KEY, else KEY; given values go before the session's and the environment's.

    In the Spark session a key is ``eventlake.KEY``.
    """

    def __init__(self, name: str, given: Mapping[str, str] | None = None, defaults: Mapping[str, str] | None = None, spark: SparkSession | None = None):
        self._name, self._given, self._defaults, self._spark = name.upper(), given or {}, defaults or {}, spark

    def get(self, key: str, default: str | None = None) -> str | None:
        keys = ([f"{self._name}_{key}"] if self._name else []) + [key]
        session = (lambda k: self._spark.conf.get(f"eventlake.{k}", None)) if self._spark else lambda k: None
        for read in (self._given.get, session, os.environ.get, self._defaults.get):
            for k in keys:
                if (found := read(k)) is not None:
                    return found
        return default

    def flag(self, key: str, default: bool = False) -> bool:
        found = self.get(key)
        return default if found is None else strtobool(found)


def retry(on: type[Exception] | tuple | Callable = Exception, attempts: int = 1, wait: float = 0.0, stall: float = 0.0) -> Callable:
    """Calls again after an error, up to ``attempts`` times in all, waiting (within 5 percent) before each.

    Used bare (``@retry``) it calls once.
    """
    kinds = on if isinstance(on, tuple) else (on,)
    if not all(isinstance(k, type) and issubclass(k, BaseException) for k in kinds):
        if callable(on) and not isinstance(on, type):
            return retry()(on)
        raise TypeError(f"{on!r} is not an exception class, nor some")
    if isinstance(attempts, bool) or not isinstance(attempts, int) or not all(isinstance(x, (int, float)) for x in (wait, stall)):
        raise TypeError("attempts is a whole number; wait and stall are seconds")
    if attempts < 1 or wait < 0 or stall < 0:
        raise ValueError("attempts must be at least 1; wait and stall must not be negative")

    def decorate(f: Callable) -> Callable:
        @wraps(f)
        def run(*args, **kwargs):
            if stall:
                time.sleep(stall)
            for left in range(attempts - 1, -1, -1):
                try:
                    return f(*args, **kwargs)
                except on:
                    if not left:
                        raise
                    time.sleep(wait * random.uniform(0.95, 1.05))

        return run

    return decorate
