"""Two forms of one raster: cells (z, x, planes) and square tiles (rz, rx, one BINARY per plane)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(spark: SparkSession, width: int, height: int, size: int = 512) -> DataFrame:
    """(rz, rx, z0, x0, z1, x1): tiles of a map, those at the edge cut."""
    t = spark.range(-(-height // size)).select(F.col("id").cast("int").alias("rz"), F.explode(F.sequence(F.lit(0), F.lit(-(-width // size) - 1))).alias("rx"))
    edge = lambda c, n: F.least((F.col(c) + 1) * size, F.lit(n))
    return t.select("rz", "rx", (F.col("rz") * size).alias("z0"), (F.col("rx") * size).alias("x0"), edge("rz", height).alias("z1"), edge("rx", width).alias("x1"))


def filled(spark: SparkSession, width: int, height: int, value: int = 0, size: int = 512) -> DataFrame:
    """Cells of a map with one value, made tile by tile."""
    w = windows(spark, width, height, size)
    return w.withColumn("z", F.explode(F.sequence("z0", F.col("z1") - 1))).withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).select("z", "x", F.lit(value).alias("v"))


def to_tiles(cells: DataFrame, planes: list[str], size: int = 512) -> DataFrame:
    """(rz, rx, planes as BINARY of size*size bytes, row by row); cells that are missing are 0."""
    keyed = cells.select(F.floor(F.col("z") / size).cast("int").alias("rz"), F.floor(F.col("x") / size).cast("int").alias("rx"), "z", "x", *(F.col(p).cast("int").alias(p) for p in planes))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        rz, rx = (k.as_py() for k in key)
        at = (t.column("z").to_numpy() - rz * size) * size + t.column("x").to_numpy() - rx * size
        out = {"rz": pa.array([rz], pa.int32()), "rx": pa.array([rx], pa.int32())}
        for p in planes:
            plane = np.zeros(size * size, np.uint8)
            plane[at] = t.column(p).to_numpy().astype(np.uint8)
            out[p] = pa.array([plane.tobytes()], pa.binary())
        return pa.table(out)

    return keyed.groupBy("rz", "rx").applyInArrow(pack, "rz int, rx int, " + ", ".join(f"{p} binary" for p in planes))


def to_cells(tiles: DataFrame, planes: list[str], size: int = 512) -> DataFrame:
    """(z, x, planes as INT) of tiles."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                z, x = np.divmod(np.arange(size * size, dtype=np.int32), size)
                cols = [z + row["rz"] * size, x + row["rx"] * size, *(np.frombuffer(row[p], np.uint8).astype(np.int32) for p in planes)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols], names=["z", "x", *planes])

    return tiles.select("rz", "rx", *planes).mapInArrow(unpack, "z int, x int, " + ", ".join(f"{p} int" for p in planes))
