"""A catalog in a folder: ``namespace/.../table/metadata/vN.metadata.json``; a folder with ``namespace.json`` is a namespace."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import replace

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tabulith.catalog import Identifier, NamespaceExists, NamespaceNotEmpty, NoSuchNamespace, NoSuchTable, TableExists, check_namespace, check_table
from tabulith.plans.scan import SnapshotTable
from tabulith.sources.filesystem import filesystem, read_bytes, write_bytes
from tabulith.sources.metadata import TableMetadata
from tabulith.sources.writer import TableWriter


class LocalCatalog:
    def __init__(self, spark: SparkSession, name: str, uri: str, props: dict[str, str] | None = None) -> None:
        self.spark, self.name, self.root, self.props = spark, name, uri.rstrip("/"), dict(props or {})

    def _path(self, parts: Sequence[str]) -> str:
        return "/".join([self.root, *parts])

    def _dirs(self, parts: Sequence[str]) -> list[str]:
        fs, p = filesystem(self._path(parts), self.props)
        if fs.get_file_info(p).type != pafs.FileType.Directory:
            return []
        return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(p)) if i.type == pafs.FileType.Directory)

    def _exists(self, path: str) -> bool:
        fs, p = filesystem(path, self.props)
        return fs.get_file_info(p).type != pafs.FileType.NotFound

    def _is_namespace(self, parts: Sequence[str]) -> bool:
        return self._exists(self._path([*parts, "namespace.json"]))

    def _is_table(self, parts: Sequence[str]) -> bool:
        return bool(self._versions(parts))

    def _versions(self, parts: Sequence[str]) -> list[int]:
        fs, p = filesystem(self._path([*parts, "metadata"]), self.props)
        if fs.get_file_info(p).type != pafs.FileType.Directory:
            return []
        return [int(m[1]) for i in fs.get_file_info(pafs.FileSelector(p)) if (m := re.fullmatch(r"v(\d+)\.metadata\.json", i.base_name))]

    def _need_namespace(self, namespace: str | Sequence[str]) -> Identifier:
        ns = check_namespace(namespace)
        if not self._is_namespace(ns):
            raise NoSuchNamespace(".".join(ns))
        return ns

    def list_namespaces(self, parent: str | Sequence[str] = ()) -> list[Identifier]:
        base = self._need_namespace(parent) if parent else ()
        return [(*base, d) for d in self._dirs(base) if self._is_namespace((*base, d))]

    def create_namespace(self, namespace: str | Sequence[str], props: dict[str, str] | None = None) -> None:
        ns = check_namespace(namespace)
        if self._is_namespace(ns):
            raise NamespaceExists(".".join(ns))
        if len(ns) > 1:
            self._need_namespace(ns[:-1])
        write_bytes(self._path([*ns, "namespace.json"]), json.dumps(props or {}).encode(), self.props)

    def drop_namespace(self, namespace: str | Sequence[str]) -> None:
        ns = self._need_namespace(namespace)
        if self._dirs(ns):
            raise NamespaceNotEmpty(".".join(ns))
        fs, p = filesystem(self._path(ns), self.props)
        fs.delete_dir(p)

    def load_namespace_properties(self, namespace: str | Sequence[str]) -> dict[str, str]:
        return json.loads(read_bytes(self._path([*self._need_namespace(namespace), "namespace.json"]), self.props))

    def update_namespace_properties(self, namespace: str | Sequence[str], remove: Sequence[str] = (), update: dict[str, str] | None = None) -> dict[str, list[str]]:
        props = self.load_namespace_properties(namespace)
        report = {"removed": [k for k in remove if k in props], "updated": sorted(update or {}), "missing": [k for k in remove if k not in props]}
        props = {k: v for k, v in props.items() if k not in remove} | (update or {})
        write_bytes(self._path([*check_namespace(namespace), "namespace.json"]), json.dumps(props).encode(), self.props)
        return report

    def list_tables(self, namespace: str | Sequence[str]) -> list[Identifier]:
        ns = self._need_namespace(namespace)
        return [(*ns, d) for d in self._dirs(ns) if self._is_table((*ns, d))]

    def _metadata(self, ident: Identifier) -> tuple[int, str]:
        versions = self._versions(ident)
        if not versions:
            raise NoSuchTable(".".join(ident))
        return max(versions), self._path([*ident, "metadata", f"v{max(versions)}.metadata.json"])

    def load_table(self, identifier: str | Sequence[str]) -> SnapshotTable:
        ident = check_table(identifier)
        return SnapshotTable.load(self.spark, ident, self._metadata(ident)[1], self.props, self)

    def create_table(self, identifier: str | Sequence[str], schema: T.StructType, partition: Sequence[tuple[str, str]] = (), **options) -> TableWriter:
        ident = check_table(identifier)
        self._need_namespace(ident[:-1])
        if self._is_table(ident):
            raise TableExists(".".join(ident))
        return TableWriter.create(self.spark, self._path(ident), schema, partition, **options)

    def writer(self, identifier: str | Sequence[str]) -> TableWriter:
        ident = check_table(identifier)
        version, path = self._metadata(ident)
        return TableWriter(self.spark, self._path(ident), SnapshotTable.load(self.spark, ident, path, self.props).metadata, version)

    def update_table_properties(self, identifier: str | Sequence[str], remove: Sequence[str] = (), update: dict[str, str] | None = None) -> None:
        w = self.writer(identifier)
        w._publish(replace(w.metadata, properties={k: v for k, v in w.metadata.properties.items() if k not in remove} | (update or {})))

    def drop_table(self, identifier: str | Sequence[str]) -> None:
        """Forget the table; its data and metadata files are removed, those in the folder of an earlier name too unless another table has it now."""
        ident = check_table(identifier)
        place = TableMetadata.parse(read_bytes(self._metadata(ident)[1], self.props)).location.rstrip("/")
        fs, p = filesystem(self._path(ident), self.props)
        fs.delete_dir(p)
        earlier = tuple(place[len(self.root) + 1 :].split("/")) if place.startswith(self.root + "/") else ()
        if earlier and earlier != ident and self._exists(place) and not self._is_table(earlier):
            fs, p = filesystem(place, self.props)
            fs.delete_dir(p)

    def rename_table(self, source: str | Sequence[str], target: str | Sequence[str]) -> None:
        """The new name's folder gets the current metadata; data files stay where they are, for manifests name them by full paths."""
        a, b = check_table(source), check_table(target)
        _, path = self._metadata(a)
        self._need_namespace(b[:-1])
        if self._is_table(b):
            raise TableExists(".".join(b))
        write_bytes(self._path([*b, "metadata", "v1.metadata.json"]), read_bytes(path, self.props), self.props)
        fs, p = filesystem(self._path([*a, "metadata"]), self.props)
        for i in fs.get_file_info(pafs.FileSelector(p)):
            if i.base_name.endswith(".metadata.json"):
                fs.delete_file(i.path)
        for folder in (p, p.rsplit("/", 1)[0]):  # unless manifests or data remain
            if not fs.get_file_info(pafs.FileSelector(folder)):
                fs.delete_dir(folder)
