"""Evaluation logs: a line with the plane's size, then lines of text and pickled entries in turn.

An entry begins with the pickle format's mark for its protocol, a line with anything else. Entries are
numbers, texts and maps; nothing else is unpickled, so a log can't run code. A log is a report of one run
and is read by one task.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The pickle mark, and the texts that tell entries and lines apart.
PROTOCOL = b"\x80"
FOUND, RATE, PEER, SCORES, REBUILT, SIZES = " FAST:", "bps:", "OpenCV FAST:", "Feature results:", "RECONSTRUCTION", "Compressed adu"
TICKS, INTERVAL, LONGEST = "Ticks per second", "ticks per source interval", "t_max"
MEGA = 1024 * 1024
BEST_PSNR = 60.0

FIELDS = {
    "interval": "long", "event_bitrate": "double", "compressed_bitrate": "double", "own_features": "long", "peer_features": "long", "own_time": "long", "peer_time": "long",
    "psnr": "double", "mse": "double", "ssim": "double", "recon_psnr": "double", "recon_mse": "double", "recon_ssim": "double", "precision": "double", "recall": "double", "accuracy": "double",
}
META = {"width": "long", "height": "long", "channels": "long", "tps": "long", "ref_interval": "long"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in {"path": "string", **META, **FIELDS}.items())


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str) -> None:
        raise pickle.UnpicklingError(f"a log holds plain values, not {module}.{name}")


def parse(data: bytes) -> tuple[dict, list[dict]]:
    """What a log says about its run, and a row for each interval; the last one, which was cut off, is left out."""
    source = io.BytesIO(data)
    meta = dict(zip(("width", "height", "channels"), map(int, source.readline().decode().strip().split("x"))))
    rows: list[dict] = [{}]
    stage, at, units = "run", 0, 1

    def entry() -> object:
        return _Plain(source).load()

    while source.tell() < len(data):
        place = source.tell()
        if data[place : place + 1] != PROTOCOL:
            line = source.readline().decode().strip()
            for mark, name in ((TICKS, "tps"), (INTERVAL, "ref_interval"), (LONGEST, "longest")):
                if mark in line:
                    meta[name] = int(line.split(": ")[-1])
            continue
        value = entry()
        if isinstance(value, str):
            if FOUND in value:
                rows[-1]["peer_time" if PEER in value else "own_time"] = int(value.split(": ")[1])
            elif RATE in value:
                rows[-1]["event_bitrate"] = float(value.split(": ")[1]) / MEGA
                rows.append({})
            elif SCORES in value:
                rows[-1].update(precision=entry(), recall=entry(), accuracy=entry())
            elif REBUILT in value:
                stage, at = "rebuilt", 0
            elif SIZES in value:
                stage, at = "sizes", 0
                units = max(1, meta.get("longest", 1) // max(1, meta.get("ref_interval", 1)))
        elif isinstance(value, dict):
            scores = {k: value.get(k) for k in ("psnr", "mse", "ssim")} if "psnr" in value else {}
            if scores.get("psnr") is not None:
                scores["psnr"] = min(scores["psnr"], BEST_PSNR)
            if stage == "run":
                rows[-1].update(scores)
            elif stage == "rebuilt":
                if at < len(rows):
                    rows[at].update({f"recon_{k}": v for k, v in scores.items()})
                at += 1
        elif isinstance(value, int) and stage == "run":
            rows[-1]["own_features" if "own_features" not in rows[-1] else "peer_features"] = value
        elif isinstance(value, int) and stage == "sizes":
            for row in rows[at : at + units]:
                row["compressed_bitrate"] = value * 8 / MEGA
            at += units
    return meta, [{"interval": k, **r} for k, r in enumerate(rows[:-1])]


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each interval of the logs under ``path``."""
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(k, kinds[v]) for k, v in {"path": "string", **META, **FIELDS}.items()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                meta, rows = parse(content.as_py())
                whole = [{k: (float(v) if kinds[FIELDS.get(k, "long")] == pa.float64() and v is not None else v) for k, v in {**meta, **r}.items()} for r in rows]
                yield pa.RecordBatch.from_pylist([{"path": place, **r} for r in whole], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    return files.select("path", "content").mapInArrow(task, SCHEMA)
