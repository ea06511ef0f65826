"""A checked zip of the two output files; local files, outside the engine."""

from __future__ import annotations

import hashlib
import zipfile
from pathlib import Path

JUNK = ("__pycache__", ".git", ".DS_Store", ".pyc", "__MACOSX")


def digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def build(files: dict[str, str | Path], out: str | Path, required: tuple[str, ...] = ()) -> list[str]:
    """Zips {member: path}, then reads it back; gives the problems that :func:`verify` finds."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member, path in sorted(files.items()):
            z.write(path, member)
    return verify(out, required) + [f"differs: {m}" for m, p in files.items() if _member_digest(out, m) != digest(p)]


def verify(path: str | Path, required: tuple[str, ...] = ()) -> list[str]:
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        problems = [f"missing: {m}" for m in required if m not in names]
        problems += [f"junk: {n}" for n in names if any(j in n for j in JUNK)]
        return problems + [f"damaged: {x}" for x in [z.testzip()] if x]


def _member_digest(path: str | Path, member: str) -> str:
    with zipfile.ZipFile(path) as z, z.open(member) as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
