"""A folder whose content is switched as a whole: what is in force is named by the newest of its numbered manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """Manifests ``_versions/<number>.json`` of a folder, on any file system that Spark reaches.

    Data goes to new folders first, then :meth:`publish` renames a finished manifest into place. Until then, and after a crash
    at any step, readers see the manifest before. Of two writers that publish the same number one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs, _ = self._at(self.path)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        _, folder = self._at(f"{self.path}/_versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _file(self, number: int) -> str:
        return f"{self.path}/_versions/{number:010d}.json"

    def current(self) -> dict | None:
        """The manifest in force, with its ``number``; none if nothing was published."""
        numbers = self._numbers()
        if not numbers:
            return None
        text = "\n".join(r[0] for r in self.spark.read.text(self._file(numbers[-1]), wholetext=True).collect())
        return json.loads(text) | {"number": numbers[-1]}

    def new_folder(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def publish(self, manifest: dict, after: int | None) -> None:
        """Put a manifest in force after the one with the number ``after`` (None: the first)."""
        number = 0 if after is None else after + 1
        _, draft = self._at(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode()))
        out.close()
        _, final = self._at(self._file(number))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: version {number} was published by another writer")

    def clean(self, *kept: str) -> list[str]:
        """Delete the folders beside those of ``kept``, left over from crashes and earlier versions, and all manifests but the
        newest. Not while others read or write."""
        _, top = self._at(self.path)
        names = {k.rstrip("/").rpartition("/")[2] for k in kept}
        gone = [f.getPath() for f in self._fs.listStatus(top) if f.getPath().getName() not in names | {"_versions"}]
        for p in gone:
            self._fs.delete(p, True)
        for number in self._numbers()[:-1]:
            self._fs.delete(self._at(self._file(number))[1], False)
        return sorted(p.getName() for p in gone)
