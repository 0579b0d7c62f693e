"""Ignore rules and globs as anchored regular expressions, built once on the driver."""

from __future__ import annotations

import re

_SPECIAL = re.compile(r"[.+^${}()|\[\]\\]")


def _literal(ch: str) -> str:
    return "\\" + ch if _SPECIAL.match(ch) else ch


def glob_regex(glob: str) -> str:
    """One include glob as an anchored expression over the relative path.

    ``**`` anywhere selects segment-aware matching; ``*.ext`` is a suffix,
    ``dir/`` and ``dir/*`` are folders at any depth, everything else is a file
    or folder name at any depth.
    """
    if "**" in glob:
        return "^" + _segment_glob(glob) + "$"
    if glob.startswith("*."):
        return "^.*" + re.escape(glob[1:]) + "$"
    if glob.endswith("/*") or glob.endswith("/"):
        return "^(?:.*/)?" + re.escape(re.sub(r"/?\*?$", "", glob)) + "/.*$"
    return "^(?:.*/)?" + re.escape(glob) + "(?:/.*)?$"


def _segment_glob(glob: str) -> str:
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|.", glob, re.S)
    out, at_segment_start = [], True
    for t in tokens:
        if t == "**/" and at_segment_start:
            out.append("(?:.*/)?")
        elif t == "**/":
            out.append(".*/")
        else:
            out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or _literal(t))
        at_segment_start = t.endswith("/")
    return "".join(out)


def ignore_rule(rule: str) -> tuple[bool, bool, str] | None:
    """A gitignore line as ``(ignores, folders_only, regex)``; None for blanks and comments.

    The expression matches one path exactly; the caller tries it on the path and
    on each of its parent folders, since a file below an ignored folder stays out.
    """
    rule = rule.rstrip("\r").strip()
    if not rule or rule.startswith("#"):
        return None
    ignores = not rule.startswith("!")
    body = rule if ignores else rule[1:]
    if body.startswith("\\"):
        body = body[1:]
    folders_only = body.endswith("/")
    body = body.rstrip("/")
    head = "^" if "/" in body else "^(?:.*/)?"
    return ignores, folders_only, head + _segment_glob(body.lstrip("/")) + "$"
