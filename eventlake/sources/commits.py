"""Reading the chain of commits.

Entries are numbered without holes and never change, so a reader that knows the first n asks only
for number n and those after it.
"""

from __future__ import annotations

import json


def name(number: int) -> str:
    return f"{number:012d}.json"


def read_on(store, base: str, known: list[dict]) -> list[dict]:
    """``known`` (entries 0 to n - 1) and the entries published since, as a new list."""
    out = list(known)
    while True:
        try:
            with store.open_input_stream(f"{base}/commits/{name(len(out))}") as source:
                out.append(json.loads(source.read()))
        except FileNotFoundError:
            return out
        except ValueError:  # created but not yet written
            return out
