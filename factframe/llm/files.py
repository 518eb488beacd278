"""Files in the shared folder, opened inside tasks through Arrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyarrow import fs


class Folder:
    """A folder named by URI; a retried task writes under new names, and only names that a task has returned are read."""

    def __init__(self, uri: str):
        self.system, self.base = fs.FileSystem.from_uri(uri)
        self._open: OrderedDict = OrderedDict()

    def create(self, suffix: str):
        """(name, output stream) of a new file."""
        self.system.create_dir(self.base, recursive=True)
        name = uuid.uuid4().hex + suffix
        return name, self.system.open_output_stream(f"{self.base}/{name}", compression=None)

    def size(self, name: str) -> int:
        return self._source(name).size()

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self._source(name).read_at(length, offset)

    def _source(self, name: str):
        source = self._open.get(name)
        if source is None:
            if len(self._open) >= 8:
                self._open.popitem(last=False)[1].close()
            source = self._open[name] = self.system.open_input_file(f"{self.base}/{name}")
        else:
            self._open.move_to_end(name)
        return source
