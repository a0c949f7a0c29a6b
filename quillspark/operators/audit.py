"""A hash-chained record of events: append, rotate, resume, verify."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class AuditLog:
    """One record a line, each with the hash of the one before. A lock on a file beside it keeps writers of several processes in one chain."""

    def __init__(self, path: str, most_bytes: int = 5_000_000, most_files: int = 5):
        self.path, self.most_bytes, self.most_files = Path(path), most_bytes, most_files

    @property
    def last(self) -> str | None:
        """The hash of the last record, from the end of the file (of the one before, just after a rotation)."""
        for p in (self.path, Path(f"{self.path}.1")):
            if p.exists() and p.stat().st_size:
                with p.open("rb") as f:
                    size, want = f.seek(0, os.SEEK_END), 4096
                    while True:
                        f.seek(max(0, size - want))
                        done = f.read().rstrip().splitlines()
                        if len(done) > 1 or want >= size:
                            break
                        want *= 4
                if done:
                    return json.loads(done[-1])["hash"]
        return None

    def append(self, event: str, outcome: str, **more) -> dict:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with Path(f"{self.path}.lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            row = {"ts": datetime.now(timezone.utc).isoformat(), "event": event, "outcome": outcome, **more, "prev_hash": self.last, "hash": ""}
            row["hash"] = record_hash(row)
            if self.path.exists() and self.path.stat().st_size >= self.most_bytes:
                for i in range(self.most_files - 1, 0, -1):
                    src = self.path if i == 1 else Path(f"{self.path}.{i - 1}")
                    if src.exists():
                        os.replace(src, f"{self.path}.{i}")
            with self.path.open("a") as f:
                f.write(json.dumps(row) + "\n")
        return row


def record_hash(row: dict) -> str:
    return hashlib.sha256(json.dumps({**row, "hash": ""}, sort_keys=True).encode()).hexdigest()


def damaged(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of a log with intact: whether the record's own hash is that of its content. Not JSON: not intact."""

    @F.pandas_udf("boolean")
    def intact(values: pd.Series) -> pd.Series:
        def fine(x) -> bool:
            try:
                row = json.loads(x)
                return row["hash"] == record_hash(row)
            except (ValueError, TypeError, KeyError):
                return False

        return values.map(fine)

    return lines.withColumn("intact", intact(F.col(line)))


def verify(rows: DataFrame, chain: str, seq: str = "seq", content: Column | None = None) -> DataFrame:
    """rows with linked: prev_hash equals the hash of the row before in the same chain (the first of a chain has none), and, if `content` is given, hash is its SHA-256."""
    before = F.lag("hash").over(Window.partitionBy(chain).orderBy(seq))
    linked = F.col("prev_hash").eqNullSafe(before)
    return rows.withColumn("linked", linked if content is None else linked & F.col("hash").eqNullSafe(F.sha2(content, 256)))
