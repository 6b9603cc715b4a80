"""Finding and verifying the files of networks that a caller supplies."""

from __future__ import annotations

import hashlib
import os


class WeightsMissing(FileNotFoundError):
    """No file of that network was found."""


class ChecksumError(ValueError):
    """A file's digest is not the expected one."""


def resolve(given: str | None, variable: str, fallback: str | None = None) -> str:
    """The first that is set of an explicit path, an environment variable and a fallback; it must exist."""
    for path in (given, os.environ.get(variable), fallback):
        if path:
            if os.path.isfile(path):
                return path
            raise WeightsMissing(f"{path} does not exist")
    raise WeightsMissing(f"give a path or set {variable}")


def verify(path: str, sha256: str) -> str:
    """The path, if the file has that digest; it is read in pieces."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    if digest.hexdigest() != sha256.lower():
        raise ChecksumError(f"{path} has another digest")
    return path
