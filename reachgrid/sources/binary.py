"""Packed graph files: 64-byte header, 16-byte nodes, 12-byte edges, little-endian.

Edges of over 65,535 seconds do not fit that record. A graph that holds one is of version 3, with 14-byte edges whose
cost has four bytes.

A packed file is one region's graph and is limited to what its 32-bit offsets reach. It is
made and read as chunks: runs of records, each with its byte offset, so no task or row
holds a region. Chunks are an ordinary table; ``write_graph_files`` streams them into files.
"""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.costs import MAX_COST
from reachgrid.functions.shared import small_side, written

# Fixed values of the format.
MAGIC = 0x49534F43
HEAD = "<IBBHIIIIddHHHHfIII"
NODE = np.dtype([("x_m", "<i4"), ("y_m", "<i4"), ("first_edge_index", "<u4"), ("edge_count", "<u2"), ("flags", "<u2")])
EDGE = np.dtype([("target_index", "<u4"), ("cost_seconds", "<u2"), ("flags", "<u2"), ("word", "<u4")])
WIDE_EDGE = np.dtype([("target_index", "<u4"), ("cost_seconds", "<u4"), ("flags", "<u2"), ("word", "<u4")])

#: Records of a chunk.
RECORDS = 250_000
HEADER = (
    "file string, magic long, version int, n_nodes long, n_edges long, n_stops long, n_tedges long, origin_easting double, origin_northing double, "
    "epsg int, grid_width_px int, grid_height_px int, pixel_size_m double, node_offset long, edge_offset long, stop_offset long"
)
NODES = "file string, node_index long, x_m int, y_m int, first_edge_index long, edge_count int, flags int"
EDGES = "file string, edge_index long, source_index long, target_index long, cost_seconds int, flags int, mode_mask int, maxspeed_kph int, road_class_id int"


def pack_word(mask: Column, speed: Column, road_class: Column) -> Column:
    """Mode mask, road class and speed of an edge as one number (a long: it may pass 2**31)."""
    return mask.cast("long") + F.shiftleft(road_class.cast("long"), 8) + F.shiftleft(speed.cast("long"), 16)


def _head(data: bytes) -> dict:
    if len(data) < 64:
        raise ValueError("a packed graph starts with 64 bytes")
    v = struct.unpack_from(HEAD, data)
    names = [f.split()[0] for f in HEADER.split(", ")[1:]]
    return dict(zip(names, (v[0], v[1], *v[4:13], v[14], *v[15:])))


def _node_rows(data: bytes, first: int) -> pd.DataFrame:
    table = np.frombuffer(data, NODE)
    return pd.DataFrame({"node_index": np.arange(first, first + len(table))} | {c: table[c].astype(np.int64) for c in NODE.names})


def _edge_rows(data: bytes, first: int, version: int) -> pd.DataFrame:
    table = np.frombuffer(data, WIDE_EDGE if version >= 3 else EDGE)
    word = table["word"].astype(np.int64) if version >= 2 else np.zeros(len(table), np.int64)
    fields = {c: table[c].astype(np.int64) for c in EDGE.names[:-1]}
    return pd.DataFrame({"edge_index": np.arange(first, first + len(table))} | fields | {"mode_mask": word & 255, "maxspeed_kph": word >> 16, "road_class_id": word >> 8 & 255})


def _opened(path: str):  # noqa: ANN202
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return store, name


def _ranges(rows: DataFrame, schema: str, parse: Callable[[bytes, dict], pd.DataFrame]) -> DataFrame:
    """``parse`` of the bytes of each row's range (file, at, size and what it needs besides)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                store, name = _opened(row["file"])
                with store.open_input_file(name) as source:
                    source.seek(row["at"])
                    data = source.read(row["size"])
                if data[:2] == b"\x1f\x8b" and row["at"] == 0:
                    raise ValueError(f"{row['file']} is compressed: unpack it first")
                if len(data) < row["size"]:
                    raise ValueError(f"{row['file']} ends before its records do")
                found = parse(data, row)
                found.insert(0, "file", row["file"])
                yield found

    return rows.mapInPandas(read, schema)


def _owned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the node whose range has them, -1 if none has."""
    held = nodes.where("edge_count > 0").select("file", F.col("node_index").alias("source_index"), F.explode(F.sequence("first_edge_index", F.col("first_edge_index") + F.col("edge_count") - 1)).alias("edge_index"))
    rows = edges.join(held, ["file", "edge_index"], "left").withColumn("source_index", F.coalesce("source_index", F.lit(-1)))
    return rows.select(*[f.split()[0] for f in EDGES.split(", ")])


_RAW_EDGES = EDGES.replace("source_index long, ", "")


def read_graph_files(spark: SparkSession, glob: str, records: int = RECORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, nodes, edges) of stored graphs, read by ranges of records; compressed files are an error (``unpack``)."""
    files = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file"), F.lit(0).alias("at"), F.lit(64).alias("size"))
    header = written(_ranges(files, HEADER, lambda data, _: pd.DataFrame([_head(data)])), "graph-headers")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(count: str, offset: str, width: int | Column) -> DataFrame:
        parts = header.where(F.col(count) > 0).select("file", "version", offset, count, F.explode(F.sequence(F.lit(0), F.col(count) - 1, F.lit(records))).alias("first"))
        size = F.least(F.lit(records), F.col(count) - F.col("first")) * width
        return parts.select("file", "version", "first", (F.col(offset) + F.col("first") * width).alias("at"), size.alias("size")).repartition(n, "file", "first")

    nodes = _ranges(runs("n_nodes", "node_offset", NODE.itemsize), NODES, lambda data, row: _node_rows(data, row["first"]))
    edges = _ranges(runs("n_edges", "edge_offset", F.when(F.col("version") >= 3, WIDE_EDGE.itemsize).otherwise(EDGE.itemsize)), _RAW_EDGES, lambda data, row: _edge_rows(data, row["first"], row["version"]))
    return header, nodes, _owned(nodes, edges)


CHUNKS = "region_id string, kind string, first long, byte_offset long, content binary"


def graph_chunks(nodes: DataFrame, edges: DataFrame, extent: DataFrame, records: int = RECORDS) -> DataFrame:
    """region_id, kind (head, nodes, edges or wide-edges), first record, byte_offset and content of packed files.

    Indices that are not 0 to n - 1 in a region, and edges out of their owner's range, are errors. An empty graph, with
    its row in ``extent``, is a header alone.
    """
    given = ["epsg", "origin_easting", "origin_northing", "pixel_size_m", "grid_width_px", "grid_height_px"]
    n = nodes.groupBy("region_id").agg(F.count("*").alias("n_nodes"), F.sum("edge_count").alias("owned"))
    e = edges.groupBy("region_id").agg(F.count("*").alias("n_edges"), F.max("cost_seconds").alias("_dearest"))
    heads = written(extent.select("region_id", *given).join(n, "region_id", "left").join(e, "region_id", "left").fillna(0, ["n_nodes", "owned", "n_edges", "_dearest"]).withColumn("version", F.when(F.col("_dearest") > MAX_COST, 3).otherwise(2)), "graph-sizes")
    if heads.where("owned != n_edges").limit(1).count():
        raise ValueError("edge ranges do not fit their owners")
    sizes = small_side(heads.select("region_id", "n_nodes", "n_edges", "version"))
    ranges = nodes.select("region_id", F.col("node_index").alias("source_index"), "first_edge_index", "edge_count")
    own = F.coalesce(F.col("edge_index").between(F.col("first_edge_index"), F.col("first_edge_index") + F.col("edge_count") - 1), F.lit(False))
    word = pack_word(F.col("mode_mask"), F.col("maxspeed_kph"), F.col("road_class_id"))
    held = edges.join(ranges, ["region_id", "source_index"], "left").select("region_id", "edge_index", "target_index", "cost_seconds", "flags", word.alias("word"), own.alias("own"))

    def head(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for h in frame.to_dict("records"):
                at = 64 + NODE.itemsize * h["n_nodes"]
                first = struct.pack(HEAD, MAGIC, h["version"], 0, 0, h["n_nodes"], h["n_edges"], 0, 0, h["origin_easting"], h["origin_northing"], h["epsg"], h["grid_width_px"], h["grid_height_px"], 0, h["pixel_size_m"], 64, at, at + (WIDE_EDGE if h["version"] >= 3 else EDGE).itemsize * h["n_edges"])
                yield pd.DataFrame({"region_id": [h["region_id"]], "kind": ["head"], "first": [0], "byte_offset": [0], "content": [first]})

    def packed(rows: DataFrame, kind: str, index: str, count: str) -> DataFrame:
        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            wide = kind == "edges" and part["version"].iloc[0] >= 3
            record = NODE if kind == "nodes" else WIDE_EDGE if wide else EDGE
            part = part.sort_values(index)
            first, total = int(key[1]) * records, int(part[count].iloc[0])
            if not np.array_equal(part[index].to_numpy(), np.arange(first, min(first + records, total))):
                raise ValueError(f"{kind} of {key[0]} are not numbered from 0 on")
            if "own" in part and not part["own"].all():
                raise ValueError(f"edge ranges of {key[0]} do not fit their owners")
            at = 64 + (record.itemsize * first if record is NODE else NODE.itemsize * int(part["n_nodes"].iloc[0]) + record.itemsize * first)
            data = np.rec.fromarrays([part[c].to_numpy() for c in record.names], dtype=record).tobytes()
            return pd.DataFrame({"region_id": [key[0]], "kind": ["wide-edges" if wide else kind], "first": [first], "byte_offset": [at], "content": [data]})

        return rows.join(sizes, "region_id").groupBy("region_id", F.floor(F.col(index) / records).alias("_run")).applyInPandas(pack, CHUNKS)

    return heads.mapInPandas(head, CHUNKS).unionByName(packed(nodes, "nodes", "node_index", "n_nodes")).unionByName(packed(held, "edges", "edge_index", "n_edges"))


def read_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, nodes, edges) of chunks of ``graph_chunks``; the region is the file."""

    def of(kinds: tuple[str, ...], schema: str, parse: Callable[[bytes, int, str], pd.DataFrame]) -> DataFrame:
        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.to_dict("records"):
                    found = parse(row["content"], row["first"], row["kind"])
                    found.insert(0, "file", row["region_id"])
                    yield found

        return chunks.where(F.col("kind").isin(*kinds)).mapInPandas(read, schema)

    nodes = of(("nodes",), NODES, lambda data, first, _: _node_rows(data, first))
    edges = of(("edges", "wide-edges"), _RAW_EDGES, lambda data, first, kind: _edge_rows(data, first, 3 if kind == "wide-edges" else 2))
    return of(("head",), HEADER, lambda data, *_: pd.DataFrame([_head(data)])), nodes, _owned(nodes, edges)


def write_graph_files(chunks: DataFrame, folder: str, suffix: str = ".bin", compress: bool = False) -> None:
    """One file per region in a shared folder or store, from chunks in the order of their offsets.

    A task streams a region's chunks, one at a time in memory, to a name of its own, which is moved when whole: a task
    that is run again leaves no half file. With ``compress`` the stream is one gzip member.
    """

    def save(rows) -> None:  # noqa: ANN001
        from itertools import groupby

        for region, own in groupby(rows, key=lambda r: r["region_id"]):
            store, base = _opened(folder)
            name, at = f"{base}/{region}{suffix}", 0
            draft = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as raw:
                out = gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) if compress else raw
                for row in own:
                    if row["byte_offset"] != at:
                        raise ValueError(f"chunks of {region} leave a gap at byte {at}")
                    out.write(bytes(row["content"]))
                    at += len(row["content"])
                if compress:
                    out.close()
            store.move(draft, name)

    chunks.repartition("region_id").sortWithinPartitions("region_id", "byte_offset").foreachPartition(save)


def unpack(spark: SparkSession, glob: str, folder: str) -> None:
    """Compressed files as plain ones in ``folder``, streamed, under their names without .gz."""

    def save(rows) -> None:  # noqa: ANN001
        for row in rows:
            store, name = _opened(row["file"])
            to, base = _opened(folder)
            final = f"{base}/{name.rsplit('/', 1)[-1].removesuffix('.gz')}"
            draft = f"{final}.{uuid.uuid4().hex}"
            with store.open_input_file(name) as raw, gzip.GzipFile(fileobj=raw) as source, to.open_output_stream(draft, compression=None) as out:
                while data := source.read(1 << 22):
                    out.write(data)
            to.move(draft, final)

    spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file")).foreachPartition(save)
