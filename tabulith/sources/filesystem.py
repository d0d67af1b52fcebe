"""Opening files by location, on the driver and in tasks."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

# Property names of S3 access, and Hadoop's names for them.
S3_OPTIONS = {
    "s3.region": "fs.s3a.endpoint.region",
    "s3.access-key-id": "fs.s3a.access.key",
    "s3.secret-access-key": "fs.s3a.secret.key",
    "s3.session-token": "fs.s3a.session.token",
    "s3.proxy-uri": "fs.s3a.proxy.host",
    "s3.endpoint": "fs.s3a.endpoint",
}


def configure(spark: SparkSession, props: dict[str, str]) -> None:
    """Hand S3 properties to Spark's file systems; the endpoint may also come from AWS_S3_ENDPOINT."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, hadoop in S3_OPTIONS.items():
        value = props.get(name) or (os.environ.get("AWS_S3_ENDPOINT") if name == "s3.endpoint" else None)
        if value and name == "s3.proxy-uri":
            proxy = urlparse(value if "://" in value else f"http://{value}")
            conf.set(hadoop, proxy.hostname or "")
            if proxy.port:
                conf.set("fs.s3a.proxy.port", str(proxy.port))
        elif value:
            conf.set(hadoop, value)


def _proxy(uri: str | None) -> str | None:
    return uri if not uri or "://" in uri else f"http://{uri}"


def spark_path(location: str) -> str:
    """The location under a scheme that Spark knows: s3 and s3n are read by s3a."""
    return "s3a" + location[location.index(":") :] if location.startswith(("s3:", "s3n:")) else location


def filesystem(location: str, props: dict[str, str] | None = None) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a location and the path in it; without a scheme the warehouse's scheme, then the local disk, is taken."""
    props = props or {}
    scheme = urlparse(location).scheme
    if not scheme and urlparse(props.get("warehouse", "")).scheme not in ("", "file"):
        scheme, location = urlparse(props["warehouse"]).scheme, props["warehouse"].rstrip("/") + "/" + location.lstrip("/")
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(location).path if scheme else location
    if scheme in ("s3", "s3a", "s3n"):
        s3 = pafs.S3FileSystem(
            access_key=props.get("s3.access-key-id"),
            secret_key=props.get("s3.secret-access-key"),
            session_token=props.get("s3.session-token"),
            region=props.get("s3.region"),
            proxy_options=_proxy(props.get("s3.proxy-uri")),
            endpoint_override=props.get("s3.endpoint") or os.environ.get("AWS_S3_ENDPOINT"),
        )
        return s3, location.split("://", 1)[1]
    return pafs.FileSystem.from_uri(location)


def read_bytes(location: str, props: dict[str, str] | None = None) -> bytes:
    fs, path = filesystem(location, props)
    with fs.open_input_stream(path) as f:
        return f.read()


def write_bytes(location: str, data: bytes, props: dict[str, str] | None = None) -> None:
    """Write under another name, then move: readers see all of it or nothing."""
    fs, path = filesystem(location, props)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.urandom(6).hex()}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def remove(location: str, props: dict[str, str] | None = None) -> None:
    fs, path = filesystem(location, props)
    fs.delete_file(path)
