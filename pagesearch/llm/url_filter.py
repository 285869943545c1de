"""URL rules in a sorted array of 64-bit digests, a file that every Python worker maps."""

from __future__ import annotations

import hashlib
import mmap
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


#: Most bytes of a packed list; each node keeps one copy on its disk.
MAX_BYTES = 1 << 32


class DigestArray:
    """Rules by ascending XXH64 of their host + path, with the full strings beside the keys.

    ``packed`` is one buffer: keys, string offsets, verdict bytes, strings.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]], max_bytes: int = MAX_BYTES):
        seen: dict[str, bool] = {}
        path_lengths, self.longest_host = set(), 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            rule = host.encode().lower().decode() + path
            seen[rule] = seen.get(rule, False) or verdict == "block"  # a rule given twice blocks if either does
            path_lengths.add(len(path))
            self.longest_host = max(self.longest_host, len(host))
        self.path_lengths = sorted(path_lengths)
        order = sorted((xxhash.xxh64_intdigest(r.encode()), r) for r in seen)
        strings = [r.encode() for _, r in order]
        offsets = np.zeros(len(order) + 1, "<u8")
        offsets[1:] = np.cumsum([len(s) for s in strings]) if strings else []
        blocks = np.array([seen[r] for _, r in order], "u1")
        self.packed = np.array([k for k, _ in order], "<u8").tobytes() + offsets.tobytes() + blocks.tobytes() + b"".join(strings)
        if len(self.packed) > max_bytes:
            raise ValueError(f"a list of {len(self.packed)} bytes is beyond {max_bytes}")
        self.n = len(order)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.packed)


class OpenDigestArray:
    """A saved list, mapped: probing touches only the pages that a binary search needs, and all workers of a node share
    them, however long the list is."""

    def __init__(self, path: str, n: int):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.keys = np.frombuffer(self.map, "<u8", n)
        self.offsets = np.frombuffer(self.map, "<u8", n + 1, 8 * n)
        self.blocks = np.frombuffer(self.map, "u1", n, 16 * n + 8)
        self.base = 17 * n + 8

    def string(self, k: int) -> bytes:
        return self.map[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])]

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Index of the rule that equals each candidate, else -1."""
        probe = np.fromiter(map(xxhash.xxh64_intdigest, candidates), "<u8", len(candidates))
        at, out = np.searchsorted(self.keys, probe), np.full(len(candidates), -1, "i8")
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == probe)) if len(self.keys) else ():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == probe[i]:  # equal keys: the stored string decides
                if self.string(k) == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def rule(self, k: int) -> str:
        return self.string(k).decode()


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path as the text after ``://`` gives them; both empty without it."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def host_ends(host: str, longest: int) -> list[str]:
    """The host, if a rule's host can be as long, and what follows each of its dots within that length."""
    tail = "." + host if len(host) <= longest else host[len(host) - longest - 1 :]
    out, at = [], tail.find(".") + 1
    while at:
        out.append(tail[at:])
        at = tail.find(".", at) + 1
    return [x for x in out if x]


def judge(urls: list[str | None], rules: OpenDigestArray, path_lengths: list[int], longest_host: int) -> list[tuple[str, str, str | None, str]]:
    """Host, path, rule and verdict of each URL; a URL has as many candidates as a rule's longest host has dots, for
    each length of a rule's path."""
    parts, candidates, owner = [split_url(u) for u in urls], [], []
    for i, (host, path) in enumerate(parts):
        for end in host_ends(host, longest_host):
            for n in path_lengths:
                if n <= len(path):
                    candidates.append((end + path[:n]).encode())
                    owner.append((i, len(end) + n))
    best: dict[int, tuple[int, int]] = {}
    for c, k in enumerate(rules.find(candidates).tolist()):
        if k >= 0:
            i, length = owner[c]
            best[i] = max(best.get(i, (0, -1)), (length, k))
    return [(h, p, rules.rule(best[i][1]), "block" if rules.blocks[best[i][1]] else "allow") if i in best else (h, p, None, "allow") for i, (h, p) in enumerate(parts)]


def share(spark: SparkSession, array: DigestArray) -> str:
    """Give every node a copy of the list, through Spark; its name there."""
    name = f"rules-{hashlib.sha256(array.packed).hexdigest()[:32]}"
    path = os.path.join(SparkFiles.getRootDirectory(), name)
    if not any(f.rstrip("/").rpartition("/")[2] == name for f in spark.sparkContext.listFiles):
        array.save(path)  # anew, as an earlier call may have stopped here
        spark.sparkContext.addFile(path)
    return name


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """host, path, longest fitting rule and verdict of every page.

    A URL that no rule fits, an empty URL and a null URL are allowed with a null rule. Of rules that fit, the longest
    string wins. URLs may be of any length. Ids may be null or repeat; each row is judged by itself. Other columns are
    ignored. The list is a file that Spark brings to each node once; a list beyond MAX_BYTES is refused.
    """
    array = DigestArray(rules)
    name, n, lengths, longest = share(pages.sparkSession, array), array.n, array.path_lengths, array.longest_host

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = OpenDigestArray(SparkFiles.get(name), n)
        for b in batches:
            rows = judge(b.column(1).to_pylist(), opened, lengths, longest)
            host, path, rule, verdict = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return slim.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
WITH s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
rules(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || q, length(h || q)) AS rule, coalesce(arg_max(verdict, length(h || q)), 'allow') AS verdict
FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id
"""
