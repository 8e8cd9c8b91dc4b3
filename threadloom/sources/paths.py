"""Checks of paths before a file is read."""

from __future__ import annotations

from pathlib import Path, PurePosixPath


def relative_path(path: str) -> str:
    """The path, if it is relative and doesn't lead upwards."""
    p = PurePosixPath(path.replace("\\", "/"))
    if not path or p.is_absolute() or ".." in p.parts or (p.parts and p.parts[0].endswith(":")):
        raise ValueError(f"not a path inside the project: {path!r}")
    return path


def safe_join(root: str, path: str) -> Path:
    """A path under root, also after following links."""
    base = Path(root).resolve()
    full = (base / relative_path(path)).resolve()
    if not full.is_relative_to(base):
        raise ValueError(f"the path leaves the project: {path!r}")
    return full
