"""Line diffs of texts in the POSIX "normal" format, made and applied without other programs.

A hunk is a command (5a6,7 or 3,4c3 or 8d7), old lines after "< ", new lines after "> ", with "---"
between them; a text whose last line has no line feed is marked as diff programs do.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

_COMMAND = re.compile(r"(\d+)(?:,(\d+))?([acd])(\d+)(?:,(\d+))?$")
_OPEN_END = "\\ No newline at end of file"


def _lines(text: str) -> list[str]:
    """Lines with their line feeds; only \\n ends a line."""
    return re.findall(r"[^\n]*\n|[^\n]+$", text)


def _range(first: int, last: int) -> str:
    return str(last) if last <= first + 1 else f"{first + 1},{last}"


def _quoted(mark: str, lines: list[str]) -> list[str]:
    out = []
    for line in lines:
        out.append(f"{mark} {line.rstrip(chr(10))}")
        if not line.endswith("\n"):
            out.append(_OPEN_END)
    return out


def create_diff(old: str, new: str) -> str:
    a, b, out = _lines(old), _lines(new), []
    for kind, a1, a2, b1, b2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "insert":
            out += [f"{a1}a{_range(b1, b2)}", *_quoted(">", b[b1:b2])]
        elif kind == "delete":
            out += [f"{_range(a1, a2)}d{b1}", *_quoted("<", a[a1:a2])]
        elif kind == "replace":
            out += [f"{_range(a1, a2)}c{_range(b1, b2)}", *_quoted("<", a[a1:a2]), "---", *_quoted(">", b[b1:b2])]
    return "".join(f"{line}\n" for line in out)


def apply_patch(old: str, diff: str) -> str:
    """``old`` with the changes of ``diff``; a diff of another text raises ValueError."""
    lines, out, at = _lines(old), [], 0
    todo = diff.split("\n")[:-1] if diff else []
    i = 0
    while i < len(todo):
        command = _COMMAND.match(todo[i])
        if not command:
            raise ValueError(f"not a diff command: {todo[i]!r}")
        first, last, kind = int(command[1]), int(command[2] or command[1]), command[3]
        i += 1
        taken: dict[str, list[str]] = {"<": [], ">": []}
        while i < len(todo) and (todo[i][:1] in "<>" and todo[i][:1] or todo[i] in ("---", _OPEN_END)):
            if todo[i] == _OPEN_END:
                held = taken[">"] or taken["<"]
                held[-1] = held[-1][:-1]
            elif todo[i] != "---":
                taken[todo[i][0]].append(todo[i][2:] + "\n")
            i += 1
        start = first if kind == "a" else first - 1
        gone = [] if kind == "a" else lines[start:last]
        if start < at or start > len(lines) or gone != taken["<"]:
            raise ValueError(f"line {first} is not what the diff was made from")
        out += lines[at:start] + taken[">"]
        at = start + len(gone)
    return "".join(out + lines[at:])
