"""Small files that one writer creates and all read: what the index keeps beside its tables.

A store offers six operations; creating a file only where none of that name is there, in one step, is the one that
commits and leases rest on. Another store (an object store's conditional put, a name node's create) takes this one's place."""

from __future__ import annotations

import os
import shutil
import uuid


class Files:
    """A folder of a file system that all writers mount."""

    def __init__(self, base: str):
        self.base = base.removeprefix("file://")

    def read(self, name: str) -> bytes | None:
        try:
            with open(f"{self.base}/{name}", "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _written(self, name: str, what: bytes) -> tuple[str, str]:
        path = f"{self.base}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{self.base}/.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.write(what)
            f.flush()
            os.fsync(f.fileno())
        return path, temp

    def create(self, name: str, what: bytes) -> bool:
        """A new file, whole, or False where one is there already."""
        path, temp = self._written(name, what)
        try:
            os.link(temp, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(temp)

    def replace(self, name: str, what: bytes) -> None:
        path, temp = self._written(name, what)
        os.replace(temp, path)

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(os.listdir(f"{self.base}/{folder}"))
        except FileNotFoundError:
            return []

    def remove(self, name: str) -> None:
        """A file or a folder with all in it; none is fine."""
        path = f"{self.base}/{name}"
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.lexists(path):
            os.remove(path)
