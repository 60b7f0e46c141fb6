"""Path filters in the style of ignore files, compiled on the driver to regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A whole-string expression for a shell pattern; ``*`` crosses slashes."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", at + 1 + (pattern[at : at + 1] == "!"))) > 0:
            body = pattern[at:end].replace("\\", "\\\\")
            negated = body.startswith("!")
            out.append(f"[{'^' if negated else ''}{body[negated:]}]")
            at = end + 1
        else:
            out.append(re.escape(c))
    return f"(?s)^{''.join(out)}$"


@dataclass(frozen=True)
class Pattern:
    """What of a path a pattern is held against (its whole, its name, its folder or each step), and how."""

    parts: tuple[str, ...]
    regex: str
    folders_only: bool = False


def compiled(pattern: str) -> Pattern:
    if pattern.startswith("/"):
        return Pattern(("path",), glob_regex(pattern[1:]))
    if pattern.endswith("/"):
        return Pattern(("path", "step"), glob_regex(pattern[:-1]), folders_only=True)
    if pattern == "**":
        return Pattern(("path",), glob_regex("*"))
    if pattern.startswith("**/"):
        return Pattern(("name",), glob_regex(pattern[3:]))
    if pattern.endswith("/**"):
        return Pattern(("folder",), glob_regex(pattern[:-3]))
    if "**" in pattern:
        return Pattern(("path",), glob_regex(pattern.replace("**", "*")))
    return Pattern(("path", "step"), glob_regex(pattern))


def sorted_out(patterns: list[str]) -> tuple[list[Pattern], list[Pattern]]:
    """Patterns that exclude, and those that ``!`` marks; blank ones and comments aside."""
    clean = [p for p in map(str.strip, patterns) if p and not p.startswith("#")]
    return [compiled(p) for p in clean if not p.startswith("!")], [compiled(p[1:]) for p in clean if p.startswith("!")]


class Matcher:
    """The same rules for paths one by one, as a walk of a tree needs them."""

    def __init__(self, patterns: list[str]) -> None:
        self.out, self.back = ([(p, re.compile(p.regex)) for p in side] for side in sorted_out(patterns))

    def hits(self, path: str, folder: bool) -> bool:
        """Whether the path itself is excluded; its folders are the caller's matter."""
        steps = path.split("/")
        seen = {"path": [path], "name": steps[-1:], "folder": ["/".join(steps[:-1])], "step": steps}

        def any_of(tests: list) -> bool:
            return any(
                regex.match(part) for p, regex in tests if folder or not p.folders_only for kind in p.parts for part in seen[kind]
            )

        return any_of(self.out) and not any_of(self.back)


def _hit(path: Column, pattern: Pattern) -> Column:
    steps = F.split(path, "/")
    hit = F.lit(False)
    for part in pattern.parts:
        if part == "path":
            hit = hit | path.rlike(pattern.regex)
        elif part == "name":
            hit = hit | F.element_at(steps, -1).rlike(pattern.regex)
        elif part == "folder":
            hit = hit | F.regexp_replace(path, "/?[^/]*$", "").rlike(pattern.regex)
        else:
            hit = hit | F.exists(steps, lambda x: x.rlike(pattern.regex))
    return hit


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a file's path, or a folder on the way to it, is excluded: some pattern hits it, and none that
    ``!`` marks does. A pattern with a final slash hits folders only."""
    out, back = sorted_out(patterns)

    def itself(at: Column, folder: bool) -> Column:
        hit = F.lit(False)
        for pattern in out:
            hit = hit | (_hit(at, pattern) if folder or not pattern.folders_only else F.lit(False))
        for pattern in back:
            hit = hit & ~(_hit(at, pattern) if folder or not pattern.folders_only else F.lit(False))
        return hit

    if not out:
        return F.lit(False)
    steps = F.split(path, "/")
    above = F.filter(
        F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")),
        lambda x: x != "",
    )
    return itself(path, False) | F.exists(above, lambda x: itself(x, True))


def invalid_reason(pattern: str) -> str | None:
    """Why an exclude pattern isn't accepted, or None."""
    reasons = {
        "empty": not pattern.strip(),
        "comment": pattern.startswith("#"),
        "control character": re.search(r"[\x00-\x08\x0e-\x1f\x7f]", pattern),
        "four stars or more in a row": "****" in pattern,
        "three slashes or more in a row": "///" in pattern,
        "bracket never closed": "[" in pattern and "]" not in pattern,
        "empty brackets": "[]" in pattern,
        "backslash": "\\" in pattern,
        "four dots or more in a row": "...." in pattern,
        "over 255 characters": len(pattern) > 255,
        "more than three double stars": pattern.count("**") > 3,
    }
    return next((reason for reason, found in reasons.items() if found), None)
