import hashlib
import random

import numpy as np

from emberlog.llm import linededup

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, kept string, lost int"


def brute(rows, shortest=10):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    held = {}
    for i, t in ((r[0], r[1] or "") for r in rows if r[0] is not None):
        for line in t.split("\n"):
            if len(key(line)) >= shortest:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in ((r[0], r[1] or "") for r in rows):
        lines = t.split("\n")
        stay = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(n=120):
    rng = random.Random(4)
    known = ["Common line of many documents", "  common LINE of many documents\t", "ÄÖÜ are not folded", "äöü are not folded", "short", "ten points", "niné point", "一二三四五六七八九十", "一二三四五六七八九", "\x0bboth ends\x0c\r", "", "   ", "K is not folded as a Kelvin"]
    rows = [(i, "\n".join(rng.choice([*known, f"line of document {i}", f"line {rng.random()}"]) for _ in range(rng.randint(1, 9))), "clash", 1) for i in range(n)]
    rows += [(500, None, "", 0), (501, "", "", 0), (502, "\n\n", "", 0), (None, "Common line of many documents\nonly here, without an id", "", 0), (None, "only here, without an id", "", 0)]
    rows += [rows[3], (7, "another text of one id\nCommon line of many documents", "", 0), (600, "x" * 200_000 + "\nten points", "", 0), (601, "x" * 200_000, "", 0), (602, "twice in one document\n" * 3, "", 0)]
    return rows


def digest_columns(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_lines_equal_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert digest_columns(linededup.dedup_lines(df)) == brute(rows)


def test_a_full_filter_changes_nothing(spark):
    rows = rows_of(60)
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    from pyspark.sql import functions as F

    got = linededup.drop_repeated_lines(df, bits=5).withColumn("kept_sha256", F.sha2("kept", 256))
    assert digest_columns(got) == brute(rows)


def test_columns_go_along(spark):
    rows = [(1, "a line of them\nb", "x"), (2, "b\nA line of them", "y"), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lost string")
    for name in ("_held", "_id", "_lost", "_cut", "kept", "n_lines", "id", "digest", "a.b"):
        df = df.withColumn(name, df["lost"])
    got = {r.doc_id: r for r in linededup.drop_repeated_lines(df).collect()}
    assert [(got[i].kept, got[i].n_lines, got[i].n_dropped) for i in (1, 2, 3)] == [("a line of them\nb", 2, 0), ("b", 2, 1), ("", 1, 0)]
    assert all(r["lost"] == r["_held"] == r["_id"] == r["a.b"] == "xyz"[i - 1] for i, r in got.items())


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_filters_miss_no_repeat_and_suspect_few(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    bits = (linededup.BITS_A_LINE * len(h)).bit_length()
    parts = [h[:12_000], h[12_000:], h[:500], h[15_000:15_300]]
    once, twice = [], []
    for p in parts:  # a task each, merged as segments are
        a, b = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
        linededup.add(a, b, p, bits)
        once.append(a)
        twice.append(b)
    seen, again = once[0], twice[0]
    for a, b in zip(once[1:], twice[1:]):
        again = again | b | (seen & a)
        seen = seen | a
    hit = linededup._test(again, linededup.positions(h, bits)).all(axis=1)
    assert hit[:500].all() and hit[15_000:15_300].all()
    assert hit.sum() - 800 < 150  # a lone hash is suspected if others set all of its bits: 0.3 percent
