"""Catalogs: finding tables by name."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import SparkSession

from tabulith.plans.scan import SnapshotTable


class CatalogError(Exception):
    """Base of all errors of catalogs."""


class NoSuchNamespace(CatalogError):
    pass


class NoSuchTable(CatalogError):
    pass


class NamespaceExists(CatalogError):
    pass


class NamespaceNotEmpty(CatalogError):
    pass


class TableExists(CatalogError):
    pass


Identifier = tuple[str, ...]


def to_identifier(name: str | Sequence[str]) -> Identifier:
    return tuple(name.split(".")) if isinstance(name, str) else tuple(name)


def table_name(identifier: Sequence[str]) -> str:
    return identifier[-1]


def namespace_of(identifier: Sequence[str]) -> Identifier:
    return tuple(identifier[:-1])


def check_table(name: str | Sequence[str]) -> Identifier:
    out = to_identifier(name)
    if len(out) < 2 or not all(out):
        raise NoSuchTable(f"missing namespace or invalid identifier {'.'.join(out)}")
    return out


def check_namespace(name: str | Sequence[str]) -> Identifier:
    out = to_identifier(name)
    if not out or not all(out):
        raise NoSuchNamespace(f"empty namespace identifier {'.'.join(out)!r}")
    return out


class Catalog(Protocol):
    def list_namespaces(self, parent: Sequence[str] = ()) -> list[Identifier]: ...
    def create_namespace(self, namespace: Sequence[str], props: dict[str, str] | None = None) -> None: ...
    def drop_namespace(self, namespace: Sequence[str]) -> None: ...
    def load_namespace_properties(self, namespace: Sequence[str]) -> dict[str, str]: ...
    def update_namespace_properties(self, namespace: Sequence[str], remove: Sequence[str] = (), update: dict[str, str] | None = None) -> dict[str, list[str]]: ...
    def list_tables(self, namespace: Sequence[str]) -> list[Identifier]: ...
    def load_table(self, identifier: Sequence[str]) -> SnapshotTable: ...
    def drop_table(self, identifier: Sequence[str]) -> None: ...
    def rename_table(self, source: Sequence[str], target: Sequence[str]) -> None: ...


def catalog_type(uri: str, props: dict[str, str]) -> str:
    """From the property ``type``, else from the URI's scheme."""
    if props.get("type"):
        return props["type"].lower()
    scheme = uri.split(":", 1)[0].lower() if ":" in uri else ""
    if scheme in ("http", "https"):
        return "rest"
    if scheme == "thrift":
        return "hive"
    if scheme in ("", "file", "s3", "s3a", "s3n", "hdfs"):
        return "local"
    raise CatalogError(f"could not infer the catalog type from {uri!r}")


def load_catalog(spark: SparkSession, name: str, uri: str, props: dict[str, str] | None = None) -> Catalog:
    kind = catalog_type(uri, props or {})
    if kind == "rest":
        from tabulith.catalog.rest import RestCatalog

        return RestCatalog(spark, name, uri, props)
    if kind == "local":
        from tabulith.catalog.local import LocalCatalog

        return LocalCatalog(spark, name, uri, props)
    raise NotImplementedError(f"catalogs of type {kind} aren't supported")
