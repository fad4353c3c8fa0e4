"""URL rules in a memory-mapped sorted array of 64-bit digests."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = {c: c + 32 for c in range(65, 91)}


class Bounds(NamedTuple):
    """Most labels and characters that the host of a rule has."""

    labels: int
    characters: int


class Index(NamedTuple):
    """Sorted digests of hosts, with the lengths of their paths (spans cut them), and of rules,
    with their verdicts (1: block) and strings (ends cut them)."""

    hosts: np.ndarray
    spans: np.ndarray
    lengths: np.ndarray
    rules: np.ndarray
    ends: np.ndarray
    verdicts: np.ndarray
    strings: np.ndarray


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without `://`."""
    m = _URL.match(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def build_index(spark, rules: list[tuple[str, str]]) -> tuple[str, Bounds]:
    """Write rules (verdict, host/path) as one file that executors map into memory.

    It holds two sorted arrays of digests (xxhash64), so that a probe is a binary search: those
    of the rules' hosts, each with the lengths of the paths that its rules have, and those of the
    whole rules, each with its verdict and its full string. A rule given twice counts once,
    `block` before `allow`. The rules are a list of the driver, and the file is as large as they.
    Returns the name under which Spark hands the file to all executors, and what bounds a url's
    probes.
    """
    merged: dict[str, bool] = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        host, _, path = rule.partition("/")
        key = f"{host.translate(_UPPER)}/{path}"
        merged[key] = merged.get(key, False) or verdict == "block"
    # hosts whose digests meet share their lengths: a wrong host costs probes of whole rules, which are confirmed
    named, lengths = {key.partition("/")[0] for key in merged}, {}
    for key in merged:
        host, _, path = key.partition("/")
        lengths.setdefault(_digest(host), set()).add(len(path))
    hosts = sorted((d, sorted(n)) for d, n in lengths.items())
    items = sorted((_digest(k), k.encode("utf-8", "surrogatepass"), v) for k, v in merged.items())
    name = f"rules-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-rules-"), name)
    with open(path, "wb") as f:
        f.write(np.array([len(hosts), sum(len(n) for _, n in hosts), len(items)], "<u8").tobytes())
        f.write(np.array([d for d, _ in hosts], "<u8").tobytes())
        f.write(np.cumsum([0, *(len(n) for _, n in hosts)], dtype="<u8").tobytes())
        f.write(np.array([x for _, n in hosts for x in n], "<u8").tobytes())
        f.write(np.array([d for d, _, _ in items], "<u8").tobytes())
        f.write(np.cumsum([0, *(len(k) for _, k, _ in items)], dtype="<u8").tobytes())
        f.write(np.array([v for _, _, v in items], "u1").tobytes())
        f.write(b"".join(k for _, k, _ in items))
    spark.sparkContext.addFile(path)
    return name, Bounds(max((h.count(".") + 1 for h in named), default=0), max(map(len, named), default=0))


@lru_cache(maxsize=4)
def open_index(name: str) -> Index:
    data = np.memmap(SparkFiles.get(name), np.uint8, "r")
    m, k, n = (int(x) for x in data[:24].view("<u8"))
    cuts = np.cumsum([24, 8 * m, 8 * (m + 1), 8 * k, 8 * n, 8 * (n + 1), n])
    part = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    return Index(*(x.view("<u8") for x in part[:5]), part[5], part[6])


def probe(index: Index, keys: list[str]) -> np.ndarray:
    """Position of each whole rule in the index, -1 where it is not; digests that meet are told
    apart by the stored strings."""
    raw = [k.encode("utf-8", "surrogatepass") for k in keys]
    want = np.fromiter((xxhash.xxh64_intdigest(k) for k in raw), np.uint64, len(raw))
    lo, hi = np.searchsorted(index.rules, want, "left"), np.searchsorted(index.rules, want, "right")
    out = np.full(len(raw), -1)
    for i in np.flatnonzero(lo < hi):
        for j in range(lo[i], hi[i]):
            if index.strings[int(index.ends[j]) : int(index.ends[j + 1])].tobytes() == raw[i]:
                out[i] = j
                break
    return out


def domains(host: str, bounds: Bounds) -> list[str]:
    """The host and the domains above it, as far as a rule's host can be as long.

    However long a host is, no more than its end is looked at.
    """
    out, at = [], len(host)
    for _ in range(bounds.labels):
        dot = host.rfind(".", max(0, len(host) - bounds.characters - 1), at)
        if dot < 0:
            if 0 < len(host) <= bounds.characters:
                out.append(host)
            break
        if dot + 1 < len(host):
            out.append(host[dot + 1 :])
        at = dot
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Judge pages(page_id, url): page_id, host, path, rule (null where none fits), verdict.

    Rules are (verdict, "host/path beginning"). A rule fits its host and all subdomains, if the
    url's path starts with /path; so a url without any path fits no rule. The rule with the
    longest text wins. Where none fits the verdict is `default`: the array lists what is known,
    and a url that it does not list has nothing against it. Null urls and urls without `://` have
    empty host and path and fit no rule. Repeated rows keep a row each; extra columns are
    ignored; an empty table gives an empty result.

    The domains of a url that a rule's host could equal are probed first, and beginnings of the
    path only for the hosts found, of the lengths that they have; the work on a url follows from
    the rules, not from the length of the url.
    """
    name, bounds = build_index(pages.sparkSession, rules)

    def judge(index, urls):
        parts = [split_url(u.as_py()) for u in urls]
        tried = [domains(h, bounds) if p[:1] == "/" else [] for h, p in parts]
        hosts = list(dict.fromkeys(d for ds in tried for d in ds))
        want = np.fromiter(map(_digest, hosts), np.uint64, len(hosts))
        at = np.searchsorted(index.hosts, want)
        known = {hosts[i]: index.lengths[int(index.spans[at[i]]) : int(index.spans[at[i] + 1])].tolist() for i in np.flatnonzero(at < len(index.hosts)) if index.hosts[at[i]] == want[i]}
        keys = [[f"{d}/{p[1 : n + 1]}" for d in ds if d in known for n in known[d] if n < len(p)] for ds, (_, p) in zip(tried, parts, strict=True)]
        every = list(dict.fromkeys(k for ks in keys for k in ks))
        place = dict(zip(every, probe(index, every).tolist(), strict=True))
        best = [max((k for k in ks if place[k] >= 0), key=lambda k: (len(k), k), default=None) for ks in keys]
        verdict = [default if k is None else "block" if index.verdicts[place[k]] else "allow" for k in best]
        return [pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], best, verdict)]

    def run(batches):
        index = open_index(name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *judge(index, b.column(1))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
