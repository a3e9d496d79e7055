"""Polygons of zipped KML files as edges of zones."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, name string, zone_id int, ord int, x1 double, y1 double, x2 double, y2 double"


def edges(raw: bytes) -> Iterator[tuple[str, int, int, float, float, float, float]]:
    """(name, zone, edge, x1, y1, x2, y2) of the outer and inner rings of the polygons in an archive's doc.kml; the
    even-odd rule makes inner rings holes."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("doc.kml"))
    tag = lambda e: e.tag.rpartition("}")[2]
    zone = 0
    for mark in (e for e in root.iter() if tag(e) == "Placemark"):
        name = next((e.text or "" for e in mark if tag(e) == "name"), "")
        for polygon in (e for e in mark.iter() if tag(e) == "Polygon"):
            zone, k = zone + 1, 0
            for c in (e for e in polygon.iter() if tag(e) == "coordinates"):
                points = [tuple(map(float, p.split(",")[:2])) for p in (c.text or "").split()]
                if points and points[0] != points[-1]:
                    points.append(points[0])
                for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
                    k += 1
                    yield name.strip(), zone, k, x1, y1, x2, y2


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """Edges of all archives under ``path``, one file a row of input."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *e) for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for e in edges(raw)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
