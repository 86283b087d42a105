"""Catalogue documents and search APIs as rows, one for each asset of an item."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

from rasterspark.sources.bytesource import HttpSource, open_source

ROW_CAP = 1000
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
SCHEMA = f"item_id string, collection string, datetime string, asset_key string, href string, media_type string, bbox {BBOX}, band_stats array<struct<min:double,max:double,mean:double,stddev:double>>"


class CatalogueError(ValueError):
    """A document or answer that is no catalogue."""


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _number(value) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def _get(value, key):
    return value.get(key) if isinstance(value, dict) else None


def _box(value) -> tuple | None:
    if not isinstance(value, list) or len(value) not in (4, 6):
        return None
    picked = value if len(value) == 4 else [value[0], value[1], value[3], value[4]]
    numbers = tuple(_number(v) for v in picked)
    return None if None in numbers else numbers


def item_rows(item) -> Iterator[tuple]:
    """Rows of an item, by asset key; an asset without a link gives none."""
    name = _text(_get(item, "id"))
    if name is None:
        raise CatalogueError("item without id")
    assets = _get(item, "assets")
    for key in sorted(assets) if isinstance(assets, dict) else ():
        asset = assets[key]
        href = _text(_get(asset, "href"))
        if href is None:
            continue
        bands = _get(asset, "raster:bands")
        stats = None
        if isinstance(bands, list):
            stats = [tuple(_number(_get(_get(b, "statistics"), k)) for k in ("minimum", "maximum", "mean", "stddev")) for b in bands]
        yield name, _text(_get(item, "collection")), _text(_get(_get(item, "properties"), "datetime")), key, href, _text(_get(asset, "type")), _box(_get(item, "bbox")), stats


def _load(data: bytes):
    try:
        return json.loads(data)
    except ValueError as e:
        raise CatalogueError(f"not JSON: {e}") from e


def _features(document) -> list:
    features = _get(document, "features")
    if not isinstance(features, list):
        raise CatalogueError("FeatureCollection without features")
    return features


def document_rows(data: bytes) -> list[tuple]:
    """Rows of an item or a collection of items."""
    document = _load(data)
    kind = _get(document, "type")
    if kind == "Feature":
        return list(item_rows(document))
    if kind == "FeatureCollection":
        return [row for f in _features(document) for row in item_rows(f)]
    raise CatalogueError(f"unsupported document type {kind!r} (expected Feature or FeatureCollection)")


def read_document(url: str) -> list[tuple]:
    try:
        return document_rows(open_source(url).read_all())
    except (OSError, ValueError, EOFError) as e:
        raise CatalogueError(f"read_stac: {e}" if url in str(e) else f"read_stac: '{url}': {e}") from e


def search_body(collections=None, bbox=None, datetime=None, limit=None) -> dict:
    """The request's body; only what is set becomes a key."""
    given = {"collections": collections, "bbox": bbox, "datetime": datetime, "limit": limit}
    return {k: v for k, v in given.items() if v is not None}


def following(original: dict, link: dict) -> tuple[str, str, dict | None]:
    """Address, method and body of the next page; a merged body lies over the original one."""
    body = link.get("body")
    if body is not None and link.get("merge") is True:
        body = {**original, **(body if isinstance(body, dict) else {})}
    return link["href"], _text(link.get("method")) or "GET", body


def _page(url: str, method: str, body: dict | None) -> tuple[list[tuple], dict | None]:
    headers = {"Accept": "application/geo+json"}
    data = None
    if body is not None:
        headers["Content-Type"] = "application/json"
        data = json.dumps(body).encode()
    status, answer = HttpSource(url).request(method.upper(), headers, data)
    if not 200 <= status < 300:
        raise CatalogueError(f"HTTP status {status}: {answer.decode('utf-8', 'replace')[:200]}")
    document = _load(answer)
    if _get(document, "type") != "FeatureCollection":
        raise CatalogueError("search response must be a FeatureCollection")
    rows = [row for f in _features(document) for row in item_rows(f)]
    links = _get(document, "links")
    link = next((x for x in links if _get(x, "rel") == "next"), None) if isinstance(links, list) else None
    return rows, link if link is not None and _text(link.get("href")) else None


def search(url: str, collections=None, bbox=None, datetime=None, page_size=None, max_rows=None) -> Iterator[tuple]:
    """Rows of all pages of a search, page after page.

    Without `max_rows`, more than ROW_CAP rows are an error and not a cut; with it, that many are returned.
    """
    if bbox is not None and len(bbox) != 4:
        raise CatalogueError(f"read_stac_search: bbox must have exactly 4 elements [xmin, ymin, xmax, ymax], got {len(bbox)}")
    if page_size is not None and page_size < 0:
        raise CatalogueError("read_stac_search: page_size must be a positive integer")
    if max_rows is not None and max_rows <= 0:
        raise CatalogueError("read_stac_search: max_rows must be a positive integer")
    original = search_body(collections, None if bbox is None else [float(v) for v in bbox], datetime, page_size)
    cap, sent = max_rows or ROW_CAP, 0
    held: list[tuple] = []
    address, method, body = url, "POST", original
    while True:
        try:
            rows, link = _page(address, method, body)
        except (OSError, ValueError) as e:
            raise CatalogueError(f"read_stac_search: '{address}': {e}") from e
        if max_rows is None:
            held += rows  # an error must come before any row
        else:
            yield from rows[: cap - sent]
        sent += len(rows)
        if sent >= cap:
            if max_rows is None and (sent > cap or link):
                raise CatalogueError(f"read_stac_search: result exceeds the default row cap ({cap}); pass max_rows to cut it, or narrow the search. Rows are pairs of item and asset.")
            break
        if link is None or not rows:
            break
        href, method, body = following(original, link)
        address = urljoin(address, href)
    yield from held
