"""A catalog behind the public REST interface."""

from __future__ import annotations

import json
import ssl
from collections.abc import Sequence
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

from tabulith import __version__
from tabulith.catalog import CatalogError, Identifier, NamespaceExists, NamespaceNotEmpty, NoSuchNamespace, NoSuchTable, TableExists, check_namespace, check_table
from tabulith.plans.scan import SnapshotTable
from tabulith.sources.filesystem import configure
from tabulith.sources.metadata import TableMetadata

SEPARATOR = "\x1f"  # fixed value: between the levels of a namespace in a URL
PROTOCOL = "0.14.1"  # fixed value: version of the interface that a client names


class RestError(CatalogError):
    pass


class BadRequest(RestError):
    pass


class Forbidden(RestError):
    pass


class Unauthorized(RestError):
    pass


class AuthorizationExpired(RestError):
    pass


class ServiceUnavailable(RestError):
    pass


class ServerError(RestError):
    pass


class CommitFailed(RestError):
    pass


class CommitStateUnknown(RestError):
    pass


class OAuthError(RestError):
    pass


# What status codes mean unless a call says otherwise.
STATUS: dict[int, type[Exception]] = {400: BadRequest, 401: Unauthorized, 403: Forbidden, 419: AuthorizationExpired, 422: RestError, 501: NotImplementedError, 503: ServiceUnavailable}


class RestCatalog:
    """``props``: ``warehouse``, ``credential`` (``id:secret`` or a secret), ``token``, ``prefix``, ``ssl.verify`` (false: any certificate) and
    ``header.NAME`` for further headers. Server defaults yield to these, and these to server overrides."""

    def __init__(self, spark: SparkSession, name: str, uri: str, props: dict[str, str] | None = None, timeout: float = 60) -> None:
        self.spark, self.name, self.timeout = spark, name, timeout
        own = dict(props or {})
        self.uri = uri.rstrip("/")
        self._headers = {"X-Client-Version": PROTOCOL, "User-Agent": f"tabulith/{__version__}", "Content-Type": "application/json"}
        self._headers |= {k[7:]: v for k, v in own.items() if k.startswith("header.")}
        self._ssl = ssl._create_unverified_context() if str(own.get("ssl.verify", "true")).lower() == "false" else None
        self.prefix = ""
        token = own.get("token") or (self._token(own["credential"], own.get("scope", "catalog")) if own.get("credential") else None)
        if token:
            self._headers["Authorization"] = f"Bearer {token}"
        query = "?" + urlencode({"warehouse": own["warehouse"]}) if own.get("warehouse") else ""
        conf = self._call("GET", f"config{query}", prefixed=False)
        self.props = (conf.get("defaults") or {}) | own | (conf.get("overrides") or {})
        self.uri = self.props.get("uri", self.uri).rstrip("/")
        self.prefix = self.props.get("prefix", "")
        if not token and self.props.get("token"):
            self._headers["Authorization"] = f"Bearer {self.props['token']}"

    # --- transport

    def _token(self, credential: str, scope: str) -> str:
        client, _, secret = credential.rpartition(":")
        form = {"grant_type": "client_credentials", "client_secret": secret, "scope": scope} | ({"client_id": client} if client else {})
        req = Request(f"{self.uri}/v1/oauth/tokens", urlencode(form).encode(), self._headers | {"Content-Type": "application/x-www-form-urlencoded"}, method="POST")
        try:
            with urlopen(req, timeout=self.timeout, context=self._ssl) as r:
                return json.load(r)["access_token"]
        except HTTPError as e:
            body = self._body(e)
            if e.code in (400, 401):
                raise OAuthError(": ".join(x for x in (body.get("error"), body.get("error_description")) if isinstance(x, str)) or str(e)) from e
            raise self._error(e, body, {}) from e
        except (URLError, KeyError) as e:
            raise RestError(str(e)) from e

    @staticmethod
    def _body(e: HTTPError) -> dict:
        try:
            x = json.loads(e.read())
            return x if isinstance(x, dict) else {}
        except ValueError:
            return {}

    def _error(self, e: HTTPError, body: dict, override: dict[int, type[Exception]]) -> Exception:
        kind = override.get(e.code) or STATUS.get(e.code) or (ServerError if e.code >= 500 else RestError)
        err = body.get("error") if isinstance(body.get("error"), dict) else {}
        return kind(f"{err.get('type', e.code)}: {err.get('message', e.reason)}")

    def _call(self, method: str, path: str, payload: object = None, override: dict[int, type[Exception]] | None = None, prefixed: bool = True) -> dict:
        base = f"{self.uri}/v1/" + (f"{self.prefix.strip('/')}/" if prefixed and self.prefix else "")
        data = None if payload is None else json.dumps(payload).encode()
        try:
            with urlopen(Request(base + path, data, self._headers, method=method), timeout=self.timeout, context=self._ssl) as r:
                text = r.read()
        except HTTPError as e:
            raise self._error(e, self._body(e), override or {}) from e
        except URLError as e:
            raise RestError(str(e.reason)) from e
        try:
            return json.loads(text) if text else {}
        except ValueError as e:
            raise RestError(f"the answer isn't JSON: {e}") from e

    def _pages(self, path: str, key: str, query: dict[str, str] | None = None) -> list:
        """All entries of a listing, page by page where the service gives a token for the next one."""
        out: list = []
        query = dict(query or {})
        while True:
            got = self._call("GET", path + ("?" + urlencode(query) if query else ""), override={404: NoSuchNamespace})
            out += got.get(key) or ()
            if not got.get("next-page-token"):
                return out
            query["pageToken"] = got["next-page-token"]

    @staticmethod
    def _ns(namespace: Sequence[str]) -> str:
        return quote(SEPARATOR.join(namespace), safe="")

    # --- namespaces

    def list_namespaces(self, parent: str | Sequence[str] = ()) -> list[Identifier]:
        return [tuple(n) for n in self._pages("namespaces", "namespaces", {"parent": SEPARATOR.join(check_namespace(parent))} if parent else None)]

    def create_namespace(self, namespace: str | Sequence[str], props: dict[str, str] | None = None) -> None:
        ns = check_namespace(namespace)
        self._call("POST", "namespaces", {"namespace": list(ns), "properties": props or {}}, {404: NoSuchNamespace, 409: NamespaceExists})

    def drop_namespace(self, namespace: str | Sequence[str]) -> None:
        self._call("DELETE", f"namespaces/{self._ns(check_namespace(namespace))}", override={404: NoSuchNamespace, 409: NamespaceNotEmpty})

    def load_namespace_properties(self, namespace: str | Sequence[str]) -> dict[str, str]:
        return self._call("GET", f"namespaces/{self._ns(check_namespace(namespace))}", override={404: NoSuchNamespace}).get("properties") or {}

    def update_namespace_properties(self, namespace: str | Sequence[str], remove: Sequence[str] = (), update: dict[str, str] | None = None) -> dict[str, list[str]]:
        path = f"namespaces/{self._ns(check_namespace(namespace))}/properties"
        out = self._call("POST", path, {"removals": list(remove), "updates": update or {}}, {404: NoSuchNamespace})
        return {k: out.get(k) or [] for k in ("removed", "updated", "missing")}

    # --- tables

    def list_tables(self, namespace: str | Sequence[str]) -> list[Identifier]:
        return [(*x["namespace"], x["name"]) for x in self._pages(f"namespaces/{self._ns(check_namespace(namespace))}/tables", "identifiers")]

    def _table(self, ident: Identifier) -> str:
        return f"namespaces/{self._ns(ident[:-1])}/tables/{quote(ident[-1], safe='')}"

    def load_table(self, identifier: str | Sequence[str]) -> SnapshotTable:
        """Options of the table override the catalog's, those of the answer both."""
        ident = check_table(identifier)
        out = self._call("GET", self._table(ident), override={404: NoSuchTable})
        meta = TableMetadata.parse(json.dumps(out["metadata"]))
        props = self.props | meta.properties | (out.get("config") or {})
        configure(self.spark, props)
        return SnapshotTable(self.spark, ident, meta, out.get("metadata-location") or "", props, self)

    def drop_table(self, identifier: str | Sequence[str]) -> None:
        self._call("DELETE", self._table(check_table(identifier)), override={404: NoSuchTable})

    def rename_table(self, source: str | Sequence[str], target: str | Sequence[str]) -> None:
        a, b = check_table(source), check_table(target)
        name = lambda i: {"namespace": list(i[:-1]), "name": i[-1]}
        self._call("POST", "tables/rename", {"source": name(a), "destination": name(b)}, {404: NoSuchTable, 409: TableExists})
