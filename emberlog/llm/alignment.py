"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

A batch of documents is one run of bytes. Token ends of both sides are counted once over the run;
documents are cut where both have one, every distinct end closes one overlapping pair of tokens, and
prefix sums give the tokens of a pair and the totals of a document.

Odd rows: texts that are null, empty, not UTF-8, or whose tokens of either side don't join to the text
behind a blank have no tokens: zeros, and '' for the groups. Repeated rows and ids are documents of
their own. Very long texts are read whole, alone in their run. Columns of any other name are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import shared_dir, stored

#: Bytes of text that one run of documents has, if a single document isn't longer.
RUN = 2_000_000
#: Pairs of ids up to which their counts are broadcast (some 100 MB of rows); more are joined by shuffle.
MOST_PAIRS = 2_000_000


class Side:
    """A tokenizer as ids of texts, and the bytes of each id."""

    def __init__(self, encode, table: list[bytes]):
        self.encode, self.table = encode, table
        self.lengths = np.array([len(x) for x in table], np.int64)


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranked(spec: dict, table: list[bytes]):
    """tiktoken's encoder for a byte-level vocabulary whose ids are the ranks of its merges; None for another.

    It gives the same ids several times as fast.
    """
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    if not plain or [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={table[i]: i for i in range(256 + len(merges))}, special_tokens={})


@lru_cache(maxsize=4)
def byte_level(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library (json); texts get a blank in front."""
    import tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = tokenizers.Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    names = {i: t for t, i in whole.get_vocab(with_added_tokens=True).items()}
    to_byte = _byte_level()
    table = [bytes(to_byte[c] for c in names[i]) if all(c in to_byte for c in names.get(i, "")) else b"" for i in range(max(names) + 1)]
    ranked = _ranked(spec, table)

    def encode(texts: list[str]) -> list[list[int]]:
        if ranked:
            return [_calm(ranked, whole, " " + t) for t in texts]
        return [whole.encode(" " + t, add_special_tokens=False).ids for t in texts]

    return Side(encode, table)


def _calm(ranked, whole, text: str) -> list[int]:
    try:
        return ranked.encode_ordinary(text)
    except BaseException as e:  # tiktoken's pattern gives up on very long runs of white space: a panic, no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return whole.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def pieces(path: str) -> Side:
    """A sentencepiece model; it sets the blank itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), table)


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Where runs of texts begin and end, of RUN bytes about."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > RUN:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(n.sum())), n


def align(texts: list[str | None], a: Side, b: Side) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
    """A run of documents: their (n_a, n_b, n_groups, n_links) as rows, digests of their groups, and
    the distinct id pairs of each, as a * |B| + b, with how often each is linked."""
    ids_a = [[] if not t else x for t, x in zip(texts, a.encode([t or "" for t in texts]), strict=True)]
    ids_b = [[] if not t else x for t, x in zip(texts, b.encode([t or "" for t in texts]), strict=True)]
    for i, t in enumerate(texts):
        if t:
            want = b" " + t.encode()
            if b"".join(map(a.table.__getitem__, ids_a[i])) != want or b"".join(map(b.table.__getitem__, ids_b[i])) != want:
                ids_a[i] = ids_b[i] = []
    flat_a, n_a = _flat(ids_a)
    flat_b, n_b = _flat(ids_b)
    # ends over the whole run: one place for each byte, and one before the first
    end_a, end_b = a.lengths[flat_a].cumsum(), b.lengths[flat_b].cumsum()
    total = int(end_a[-1]) if len(end_a) else 0
    here_a, here_b = (np.bincount(e, minlength=total + 1).astype(np.int32) for e in (end_a, end_b))
    ends = np.flatnonzero(here_a | here_b)  # each closes one pair of tokens
    both = here_a[ends] & here_b[ends]  # and here is a cut
    before_a, before_b = here_a[ends].cumsum() - here_a[ends], here_b[ends].cumsum() - here_b[ends]
    doc_last_a = n_a.cumsum()
    doc_end = np.r_[0, end_a][doc_last_a]  # the byte behind each document
    upto = np.searchsorted(ends, doc_end, side="right")
    begin = np.r_[0, upto[:-1]]
    cuts = np.r_[0, both.cumsum()]
    n_groups, n_links = cuts[upto] - cuts[begin], upto - begin
    # tokens in the order of their group, first those of A: each token's group, then its place
    closed = ends[both == 1]
    group_a, group_b = np.searchsorted(closed, end_a), np.searchsorted(closed, end_b)
    count_a, count_b = np.bincount(group_a, minlength=len(closed)), np.bincount(group_b, minlength=len(closed))
    place_a = np.arange(len(flat_a)) + (count_b.cumsum() - count_b)[group_a]
    place_b = np.arange(len(flat_b)) + count_a.cumsum()[group_b]
    last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True][: len(flat_a)], np.r_[group_b[1:] != group_b[:-1], True][: len(flat_b)]
    order = np.empty(len(flat_a) + len(flat_b), np.int64)
    order[place_a], order[place_b] = 2 * flat_a + last_a, 2 * (len(a.table) + flat_b) + last_b
    words = _words(len(a.table), len(b.table))
    at = np.r_[0, (n_a + n_b).cumsum()]
    digests = []
    for i in range(len(texts)):
        said = b"".join(map(words.__getitem__, order[at[i] : at[i + 1]].tolist()))
        digests.append(hashlib.sha256(said[:-1]).hexdigest() if said else "")
    pair = flat_a[before_a] * len(b.table) + flat_b[before_b] if len(ends) else np.zeros(0, np.int64)
    # distinct pairs of each document: sorted by document, then pair
    doc = np.repeat(np.arange(len(texts)), n_links)
    rank = np.lexsort((pair, doc))
    pair, doc = pair[rank], doc[rank]
    fresh = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])][: len(pair)])
    times = np.diff(np.r_[fresh, len(pair)])
    split = np.bincount(doc[fresh], minlength=len(texts)).cumsum()[:-1]
    return np.stack([n_a, n_b, n_groups, n_links]), digests, np.split(pair[fresh], split), np.split(times, split)


@lru_cache(maxsize=4)
def _words(size_a: int, size_b: int) -> list[bytes]:
    """Decimal ids with what follows: of A a comma or, last in its group, a bar; of B a comma or a semicolon."""
    return [b"%d%s" % (i, c) for n, last in ((size_a, b"|"), (size_b, b";")) for i in range(n) for c in (b",", last)]


def aligned(documents: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, int]:
    """Each document's counts and digest, and its distinct id pairs (pairs, times); and |B|, to tell a pair's ids."""
    a, b = byte_level(path_a), pieces(path_b)
    size_b, short = len(b.table), len(a.table) * len(b.table) < 2**31
    kind = pa.int32() if short else pa.int64()
    out = pa.schema([("doc_id", to_arrow_type(documents.schema["doc_id"].dataType)), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(kind)), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _runs(texts):
                numbers, digests, pairs, times = align(texts[i:j], a, b)
                offsets = np.r_[0, np.cumsum([len(x) for x in pairs])].astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), t)) for x, t in ((pairs, kind), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, numbers), pa.array(digests), *lists], schema=out)

    text = F.when(F.is_valid_utf8("text"), F.col("text"))
    schema = T.StructType([documents.schema["doc_id"]]).add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long").add("groups_sha256", "string")
    schema = schema.add("pairs", T.ArrayType(T.IntegerType() if short else T.LongType())).add("times", T.ArrayType(T.IntegerType()))
    return documents.select("doc_id", text.alias("text")).mapInArrow(run, schema), size_b


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, documents, best): how many documents hold a pair linked, and whether no pair of its A id is held by more."""
    n = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")).withColumn("a", F.expr(f"pair div {size_b}"))
    most = n.groupBy("a").agg(F.max("documents").alias("most"))
    return n.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def link_table(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The vocabularies' map that the corpus gives: (a, b, documents, best) of each linked id pair."""
    found, size_b = aligned(documents, path_a, path_b)
    counts = pair_counts(found, size_b)
    return counts.select(F.expr(f"pair div {size_b}").alias("a"), F.expr(f"pair % {size_b}").alias("b"), "documents", "best")


def align_documents(documents: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Each document's counts, with n_best and count_sum from the corpus' counts of its pairs.

    Texts are read once; documents are stored with their distinct pairs. Pairs are counted with
    partial sums. Their counts are broadcast if they are `most_pairs` at most; else documents'
    pairs meet them by a shuffle, which adaptive execution splits where a pair is hot.
    """
    folder = shared_dir(documents.sparkSession)
    found, size_b = aligned(documents, path_a, path_b)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), folder, "aligned")
    counts = stored(pair_counts(found, size_b), folder, "pairs")
    if counts.count() <= most_pairs:
        counts = F.broadcast(counts)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
