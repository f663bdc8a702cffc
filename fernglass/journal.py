"""A journal of a batch of writes: what each file held before, so that an unfinished batch can be taken back."""

from __future__ import annotations

import base64
import json
import uuid

FOLDER = ".journal"


class Journal:
    """Kept beside the records as one file per changed record, written before the change; ``close`` ends the batch."""

    def __init__(self, files):
        self.files, self.name, self.seen = files, f"{FOLDER}/{uuid.uuid4().hex}", []

    def before(self, path: str) -> None:
        """Notes what ``path`` holds now, once."""
        if path in self.seen or path.startswith(f"{FOLDER}/"):
            return
        held = base64.b64encode(self.files.read(path)).decode() if self.files.exists(path) else None
        self.files.put(f"{self.name}/{len(self.seen):06d}", json.dumps({"path": path, "data": held}).encode())
        self.seen.append(path)

    def adopt(self, inner: "Journal") -> None:
        """Takes over the notes of an operation within the batch."""
        for k, path in enumerate(inner.seen):
            if path not in self.seen:
                self.files.put(f"{self.name}/{len(self.seen):06d}", self.files.read(f"{inner.name}/{k:06d}"))
                self.seen.append(path)
        inner.close()

    def close(self) -> None:
        if self.seen:
            self.files.drop(self.name)


def undo(files, name: str) -> list[str]:
    """Puts back what the files of a journal held, the latest first; gives their paths."""
    paths = []
    for entry in sorted(files.names(name), reverse=True):
        note = json.loads(files.read(f"{name}/{entry}"))
        if note["data"] is not None:
            files.put(note["path"], base64.b64decode(note["data"]))
        elif files.exists(note["path"]):
            files.drop(note["path"])
        paths.append(note["path"])
    files.drop(name)
    return paths
