"""URL sources: a Python data source and the same for a column of URLs, with a ceiling that holds while a body streams.

    spark.dataSource.register(web.WebSource)
    spark.read.format("web").option("urls", json.dumps([...])).option("max_bytes", 10_000_000).load()

A URL is a row whatever becomes of it: content, or a reason why there is none. Only http and https are asked, redirects too.
A refused body leaves at most the ceiling and one piece in memory.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status int, content binary, extension string, reason string, error_kind string"
#: Bytes of a body at most, bytes read at once, redirects followed, seconds that a server may be silent, URLs a partition.
CEILING, PIECE, REDIRECTS, SILENT, TOGETHER = 50 << 20, 1 << 16, 10, 30.0, 64


class _Web(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if urlsplit(newurl).scheme not in ("http", "https"):
            raise urllib.error.URLError("redirected to another scheme")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def extension_of(url: str) -> str:
    """The suffix of a URL's path, by which a parser is chosen; .txt if there is none to speak of."""
    name = urlsplit(url).path.rsplit("/", 1)[-1]
    suffix = name[name.rfind(".") :] if "." in name[1:] else ""
    return suffix if 1 < len(suffix) <= 10 else ".txt"


def fetch(url: str | None, max_bytes: int = CEILING, silent: float = SILENT) -> tuple:
    """A row of SCHEMA. error_kind: fatal for what no retry mends, timeout, or retryable."""

    def refused(reason: str, kind: str, status: int | None = None, final: str | None = None) -> tuple:
        return url, final, status, None, None, reason, kind

    try:
        if url is None or urlsplit(url).scheme not in ("http", "https") or not urlsplit(url).hostname:
            return refused("no http or https URL", "fatal")
        opener = urllib.request.build_opener(_Web)
        opener.handlers = [h for h in opener.handlers if not isinstance(h, (urllib.request.FileHandler, urllib.request.FTPHandler, urllib.request.DataHandler))]
        with opener.open(urllib.request.Request(url, headers={"Accept-Encoding": "identity"}), timeout=silent) as answer:
            final, status, declared = answer.url, answer.status, answer.headers.get("Content-Length", "")
            if declared.isdigit() and int(declared) > max_bytes:
                return refused("too large: declared", "fatal", status, final)
            body = bytearray()
            while piece := answer.read(PIECE):
                body += piece
                if len(body) > max_bytes:
                    return refused("too large: while reading", "fatal", status, final)
            if declared.isdigit() and len(body) < int(declared):
                return refused("the body ended early", "retryable", status, final)
            return url, final, status, bytes(body), extension_of(final), None, None
    except urllib.error.HTTPError as e:
        kind = "timeout" if e.code in (408, 504) else "retryable" if e.code == 429 or e.code >= 500 else "fatal"
        moved = e.code in (301, 302, 303, 307, 308)
        reason = "redirected to another scheme" if moved and "not allowed" in str(e) else "too many redirects" if moved else f"status {e.code}"
        return refused(reason, kind, e.code, e.url)
    except TimeoutError:
        return refused("timed out", "timeout")
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            return refused("timed out", "timeout")
        return refused(str(e.reason), "retryable" if isinstance(e.reason, OSError) else "fatal")
    except OSError as e:
        return refused(str(e) or type(e).__name__, "retryable")
    except Exception as e:  # noqa: BLE001 - a URL or an answer that cannot be read is a row, too
        return refused(str(e) or type(e).__name__, "fatal")


class Urls(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], max_bytes: int, silent: float, together: int) -> None:
        self.urls, self.max_bytes, self.silent, self.together = urls, max_bytes, silent, together

    def partitions(self) -> list[Urls]:
        return [Urls(self.urls[i : i + self.together]) for i in range(0, len(self.urls), self.together)] or [Urls([])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch(url, self.max_bytes, self.silent)


class WebSource(DataSource):
    """Options: urls (a JSON list), max_bytes, silent (seconds), together (URLs a partition)."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(json.loads(o.get("urls", "[]")), int(o.get("max_bytes", CEILING)), float(o.get("silent", SILENT)), max(1, int(o.get("together", TOGETHER))))


def fetched(urls: DataFrame, column: str = "url", max_bytes: int = CEILING, silent: float = SILENT) -> DataFrame:
    """SCHEMA rows of a column of URLs, a body at a time in each task; repeated URLs are asked again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(fetch(url, max_bytes, silent), kinds, strict=True)], names=names)

    return urls.select(column).mapInArrow(run, SCHEMA)
