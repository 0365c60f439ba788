"""Globs, safe paths and short forms, on the driver."""

from __future__ import annotations

import posixpath
import re


def glob_to_like(glob: str) -> str:
    """A LIKE pattern for a glob: `**/` any folders or none, `*` and `**` anything, `?` one character."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "%", at + 3
        elif glob[at] == "*":
            while at < len(glob) and glob[at] == "*":
                at += 1
            out += "%"
        elif glob[at] == "?":
            out, at = out + "_", at + 1
        else:
            out, at = out + re.sub(r"([\\%_])", r"\\\1", glob[at]), at + 1
    return re.sub("%+", "%", out)


def safe_path(root: str, path: str) -> str | None:
    """path below root in normal form, or None where it has a NUL, leaves root or is root itself."""
    if "\0" in path:
        return None
    full = posixpath.normpath(posixpath.join(root, path))
    return full if full.startswith(posixpath.normpath(root) + "/") else None


def short_commit(text: str | None) -> str | None:
    """A commit's first twelve digits; any other text as it is."""
    return text[:12] if text and re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", text) else text


def redact(message: str, root: str) -> str:
    return message.replace(root, "<repo>")
