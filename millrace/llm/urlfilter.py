"""URL filters on a sorted digest array.

Rules are (host, path, verdict). Their 64-bit xxhash keys are sorted into one array, beside offsets into a blob of the full strings; each
Python worker memory-maps one file that holds all three. A batch of URLs is turned into candidate keys (host suffixes at label
boundaries, joined to path prefixes of the lengths that rules have), probed with a vectorised binary search, and every hit is confirmed
against the stored string, so a collision can't decide. A rule list beyond `max_index_bytes` is cut by digest into several arrays, which the
URLs meet one after another; the best rule so far goes along.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged

MAX_INDEX_BYTES = 64 << 20


def _key(host: str, path: str) -> bytes:
    return host.encode() + b"\x00" + path.encode()


class DigestArray:
    """Sorted uint64 digests over a blob of strings, in one memory-mapped file that is unlinked at once."""

    def __init__(self, raw: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(raw or b"\0")
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = np.frombuffer(self.map, np.int64, 2)
        self.keys = np.frombuffer(self.map, np.uint64, n, 16)
        self.ends = np.frombuffer(self.map, np.int64, n + 1, 16 + 8 * n)
        self.lengths = np.frombuffer(self.map, np.int64, m, 16 + 16 * n + 8)
        self.blob = 16 + 16 * n + 8 + 8 * m

    @staticmethod
    def pack(strings: Sequence[bytes], path_lengths: Sequence[int]) -> bytes:
        keyed = sorted((xxhash.xxh64_intdigest(s), s) for s in set(strings))
        ends = np.cumsum([0] + [len(s) for _, s in keyed]).astype(np.int64)
        return b"".join(
            [
                np.array([len(keyed), len(path_lengths)], np.int64).tobytes(),
                np.array([k for k, _ in keyed], np.uint64).tobytes(),
                ends.tobytes(),
                np.array(sorted(path_lengths), np.int64).tobytes(),
                *(s for _, s in keyed),
            ]
        )

    def find(self, strings: Sequence[bytes]) -> np.ndarray:
        """Whether each string is stored: binary search by digest, then the full string."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        low, high = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        hit = np.zeros(len(strings), bool)
        for i in np.flatnonzero(low < high):
            hit[i] = any(self.map[self.blob + self.ends[j] : self.blob + self.ends[j + 1]] == strings[i] for j in range(low[i], high[i]))
        return hit


def _suffixes(host: str) -> list[str]:
    """The host, then what is left after each dot."""
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def _probe(packed):
    """Adds the best rule of one array to rows of page_id, host, path and the best so far (rule_host, rule_path, verdict; null where none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_hosts, raw_rules, verdicts = packed.value
        hosts, rules = DigestArray(raw_hosts), DigestArray(raw_rules)
        lengths = [int(x) for x in rules.lengths]
        for batch in batches:
            host, path, *held = (batch.column(c).to_pylist() for c in ("host", "path", "rule_host", "rule_path", "verdict"))
            flat = [(i, s) for i, h in enumerate(host) for s in _suffixes(h)]
            keep = hosts.find([s.encode() for _, s in flat]) if flat else []
            asks = [(i, s, path[i][:n]) for (i, s), ok in zip(flat, keep, strict=True) if ok for n in lengths if n <= len(path[i])]
            hits = rules.find([_key(s, p) for _, s, p in asks]) if asks else []
            rank = lambda s, p: (len(s) + len(p), len(s))
            best = list(zip(*held, strict=True))
            for (i, s, p), ok in zip(asks, hits, strict=True):
                if ok and (best[i][0] is None or rank(s, p) > rank(*best[i][:2])):
                    best[i] = s, p, verdicts[s, p]
            found = zip(*best, strict=True) if best else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), *(pa.array(c, pa.string()) for c in found)], ["page_id", "host", "path", "rule_host", "rule_path", "verdict"])

    return run


def _arrays(verdicts: dict, max_index_bytes: int) -> Iterator[tuple[bytes, bytes, dict]]:
    """(hosts, rules, verdicts) of the rules in order of digest, about max_index_bytes at a time."""
    order = sorted(verdicts, key=lambda r: (xxhash.xxh64_intdigest(_key(*r)), r))
    sizes = np.cumsum([24 + 3 * len(_key(*r)) for r in order])
    part = (sizes // max(1, max_index_bytes)).tolist()
    for _, some in groupby(zip(part, order, strict=True), key=lambda x: x[0]):
        held = {r: verdicts[r] for _, r in some}
        yield DigestArray.pack([h.encode() for h, _ in held], []), DigestArray.pack([_key(h, p) for h, p in held], sorted({len(p) for _, p in held})), held


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path. Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumn("host", F.coalesce(F.translate(host, upper, lower), F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def filter_urls(urls: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest host + path wins, of equal ones that
    with the longer host. A null URL, or one without ://, has an empty host and path, so only a rule with an empty host fits it. Rules given
    twice count once, the last verdict holds. A null id is returned as it is; repeated rows are judged each; other columns aren't read.
    """
    spark: SparkSession = urls.sparkSession
    verdicts = {(h, p): v for h, p, v in rules}
    none = F.lit(None).cast("string")
    found = split_url(urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url").select("page_id", "host", "path", none.alias("rule_host"), none.alias("rule_path"), none.alias("verdict"))
    schema = f"page_id {dict(found.dtypes)['page_id']}, host string, path string, rule_host string, rule_path string, verdict string"
    arrays = list(_arrays(verdicts, max_index_bytes))
    for array in arrays:
        packed = spark.sparkContext.broadcast(array)
        found = found.mapInArrow(_probe(packed), schema)
        if len(arrays) > 1:  # so that one array at a time is in memory
            found = staged(found, "urls")
            packed.destroy()
    return found.select("page_id", "host", "path", F.concat("rule_host", "rule_path").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
