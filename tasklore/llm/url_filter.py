"""Operator 7, URL rules looked up in a sorted digest array.

The keys of all rules are 64-bit xxhash digests in one sorted array, kept in files that Spark ships to every executor and tasks map into
memory. All (host suffix, path prefix) keys of a batch of URLs are probed with one vectorised binary search, and a hit
counts only if the stored string is the probed one, so a digest collision decides nothing.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict;
of rules that fit, the longest (host and path together, then host) wins; rows that repeat are judged alike; without rules all get the default.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from tasklore.llm.common import strings

# The rules the query applies, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"
ADDRESS = re.compile(r"://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARD_RULES = 5_000_000


def host_and_path(url: str | None) -> tuple[str, str]:
    found = ADDRESS.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


class DigestShard:
    """One sorted digest array with its strings. ``find`` is exact: a digest hit is confirmed by the string."""

    PARTS = ("digests", "ends", "text", "blocked")

    def __init__(self, files: dict[str, str]):
        self.digests, self.ends, self.text, self.blocked = (np.load(files[part], mmap_mode="r") for part in self.PARTS)

    @classmethod
    def write(cls, rules: list[tuple[str, str, str]], folder: str) -> dict[str, str]:
        rows = sorted((xxhash.xxh64_intdigest(host + path), (host + path).encode(), verdict == "block") for verdict, host, path in rules)
        arrays = {
            "digests": np.array([row[0] for row in rows], np.uint64),
            "ends": np.cumsum([0] + [len(row[1]) for row in rows]).astype(np.int64),
            "text": np.frombuffer(b"".join(row[1] for row in rows) or b" ", np.uint8),
            "blocked": np.array([row[2] for row in rows], np.bool_),
        }
        names = {}
        for part in cls.PARTS:
            names[part] = f"rules-{part}-{uuid.uuid4().hex}.npy"
            np.save(Path(folder, names[part]), arrays[part])
        return names

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For every key, whether a rule has it, and whether that rule blocks. A block wins if a key has both verdicts."""
        wanted = np.fromiter((xxhash.xxh64_intdigest(key) for key in keys), np.uint64, len(keys))
        begin, end = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        found, blocked = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for number in np.flatnonzero(begin < end):
            raw = keys[number].encode("utf-8", "replace")
            for place in range(begin[number], end[number]):
                if self.text[self.ends[place]:self.ends[place + 1]].tobytes() == raw:
                    found[number] = True
                    blocked[number] |= bool(self.blocked[place])
        return found, blocked


def ship(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> tuple[list[dict[str, str]], list[int], list[int]]:
    """Build shards of at most ``SHARD_RULES`` rules one after another and hand their files to Spark for all executors.

    ``rules`` may be any iterable, such as ``DataFrame.toLocalIterator()``: the driver holds one shard of it. Also returns the lengths of rule paths
    and the numbers of labels of rule hosts.
    """
    shards, lengths, labels, pending = [], set(), set(), []
    folder = tempfile.mkdtemp(prefix="rules-")  # read by the driver's file server alone, as long as the application lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)

    def close() -> None:
        names = DigestShard.write(pending, folder)
        for name in names.values():
            spark.sparkContext.addFile(str(Path(folder, name)))
        shards.append(names)
        pending.clear()

    for verdict, host, path in rules:
        pending.append((verdict, host.translate(LOWER), path))
        lengths.add(len(path))
        labels.add(host.count(".") + 1)
        if len(pending) >= SHARD_RULES:
            close()
    if pending:
        close()
    return shards, sorted(lengths), sorted(labels)


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[tuple[int, int, str]]:
    """(length, host length, key) of the host suffixes with as many labels as some rule's host, with every path prefix as long as some rule's."""
    parts = host.rsplit(".", labels[-1]) if host and labels else []
    found = []
    for number in labels:
        if number < len(parts) or number == len(parts) == host.count(".") + 1:
            suffix = ".".join(parts[-number:])
            if suffix:
                found += [(len(suffix) + length, len(suffix), suffix + path[:length]) for length in lengths if length <= len(path)]
    return found


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; one pass, no shuffle."""
    shards, lengths, labels = ship(pages.sparkSession, rules)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [DigestShard({part: SparkFiles.get(name) for part, name in names.items()}) for names in shards]
        for batch in batches:
            addresses = [host_and_path(url) for url in strings(batch, "url")]
            probes = [(row, *probe) for row, (host, path) in enumerate(addresses) for probe in candidates(host, path, lengths, labels)]
            keys = [probe[3] for probe in probes]
            best: list[tuple | None] = [None] * len(addresses)
            for shard in opened:
                found, blocked = shard.find(keys)
                for number in np.flatnonzero(found):
                    row, *rank, key = probes[number]
                    hit = (rank, bool(blocked[number]), key)
                    best[row] = max(best[row], hit) if best[row] else hit
            verdicts = [default if hit is None else "block" if hit[1] else "allow" for hit in best]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([host for host, _ in addresses], pa.string()), pa.array([path for _, path in addresses], pa.string()),
                pa.array([hit[2] if hit else None for hit in best], pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string")


def judge_pages(pages: DataFrame) -> DataFrame:
    """The contract of op7."""
    return judge(pages, RULES)
