"""Plain files in the shared folder, opened from tasks through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str):
    """The file system of a URI and the path in it; a URI without a scheme is a local path."""
    return fs.FileSystem.from_uri(uri)


def create(folder: str, stem: str, suffix: str):
    """A new file with a name no other attempt of the task uses: (its URI, its stream)."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def read_ranges(places, gap: int = 1 << 16, most: int = 8 << 20):
    """The bytes of (uri, offset, length) places that come sorted by file and offset.

    Neighbours at most `gap` bytes apart are fetched with one read of at most about `most` bytes.
    """
    pending: list[tuple[str, int, int]] = []

    def fetch():
        uri, first = pending[0][0], pending[0][1]
        system, path = opened(uri)
        with system.open_input_file(path) as f:
            f.seek(first)
            data = f.read(max(o + n for _, o, n in pending) - first)
        for _, o, n in pending:
            yield data[o - first : o - first + n]

    for place in places:
        if pending and (place[0] != pending[0][0] or place[1] > pending[-1][1] + pending[-1][2] + gap or place[1] + place[2] - pending[0][1] > most):
            yield from fetch()
            pending = []
        pending.append(place)
    if pending:
        yield from fetch()
