"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat verb, intention, target, negation, reported speech, other).
Five small transducers, whose arcs carry factors, rewrite the symbols of a clause: insults that
follow each other weigh more; a threat verb counts as meant behind an intention; a target aims an
insult behind it or a threat before it; negation and reported speech weaken what stands in their
reach. They are composed into one machine. What it writes for a clause is weighed by the lexicon
and the factors of its path and summed over the text, and a logistic model turns the sums into a
score. So matched clauses are scored, and not words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, one_per_bucket, remainder, shared_dir, stored

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:|\n]+")
#: Most documents of each label that training takes, and the lengths of learned stems.
SAMPLE, STEMS = 6000, (3, 4, 5, 6, 7, 8)
#: Toxic documents that a lexeme needs at least.
SUPPORT = 3

INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb imbecile dummkopf abschaum widerlich salaud connard imbécile crétin basura estúpido imbécil asqueroso".split()
THREATS = "kill hurt destroy beat strangle shoot stab umbringen töten vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yourself he she they him her them du dich dir ihr euch tu toi vous te él ella ustedes usted".split()
NEGATIONS = "not never no nobody isn aren wasn don doesn nicht nie kein keine pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says say wrote writes quoted reported called according sagte sagt schrieb laut dit écrit selon dijo dice escribió según".split()
INTENTIONS = "will ll gonna going shall want werde werden will wollen vais va voy vamos quiero".split()
CUES = {w: s for s, ws in {"M": INTENTIONS, "T": THREATS, "Y": TARGETS, "N": NEGATIONS, "R": REPORTS}.items() for w in ws}

#: What the machine writes of interest: plain, aimed, negated, reported insult; bare, meant, aimed,
#: negated, reported threat.
OUTPUTS = "IAijvTXtq"
SYMBOLS = "ITMYNRO"
#: Weight of a threat verb; insults have theirs from the lexicon.
THREAT = 3.0


class Transducer:
    """Deterministic and weighted: an arc from (state, symbol) gives a state, a symbol and a factor."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: other reads what self writes, and factors multiply."""
        start, arcs, todo = (self.start, other.start), {}, [(self.start, other.start)]
        seen, symbols = {start}, {s for _, s in self.arcs}
        while todo:
            a, b = todo.pop()
            for s in symbols:
                a2, mid, x = self.arcs[a, s]
                b2, out, y = other.arcs[b, mid]
                arcs[(a, b), s] = (a2, b2), out, x * y
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)

    def numbered(self) -> Transducer:
        """The same machine with states 0, 1, ... from its start on."""
        names = {self.start: 0}
        for state, _ in self.arcs:
            names.setdefault(state, len(names))
        return Transducer(0, {(names[a], s): (names[b], out, x) for (a, s), (b, out, x) in self.arcs.items()})

    def run(self, symbols) -> list[tuple[str, float]]:
        state, out = self.start, []
        for s in symbols:
            state, written, factor = self.arcs[state, s]
            out.append((written, factor))
        return out


def window(cues: str, rewrite: dict[str, str], reach: int, symbols: str, factor: float = 1.0, outside: dict[str, str] | None = None) -> Transducer:
    """After a cue, rewrite symbols, at a factor, for `reach` words (0: to the clause's end)."""
    span, arcs = reach or 1, {}
    for state in range(span + 1):
        for s in symbols:
            left = span if s in cues or (state and not reach) else max(0, state - 1)
            hit = state and s in rewrite
            arcs[state, s] = left, rewrite[s] if hit else (outside or {}).get(s, s), factor if hit else 1.0
    return Transducer(0, arcs)


def aim(symbols: str, before: int = 4, after: int = 3) -> Transducer:
    """A target aims the insults up to `before` words behind it, and is itself the aim of a threat
    up to `after` words before it. A state is how far both still reach."""
    arcs = {}
    for near in range(before + 1):
        for open_ in range(after + 1):
            for s in symbols:
                to = (before if s == "Y" else max(0, near - 1), after if s in "vT" else max(0, open_ - 1))
                out, factor = ("A", 1.2) if s == "I" and near else ("X", 1.0) if s == "Y" and open_ else (s, 1.0)
                arcs[(near, open_), s] = (to[0], 0 if out == "X" else to[1]), out, factor
    return Transducer((0, 0), arcs)


INSULT = window("I", {"I": "I"}, 3, SYMBOLS, factor=1.25)
THREATEN = window("M", {"T": "T"}, 3, SYMBOLS, factor=1.5, outside={"T": "v"})
TARGET = aim(SYMBOLS + "v")
NEGATE = window("N", {"I": "i", "A": "i", "v": "O", "T": "t", "X": "t"}, 3, SYMBOLS + "vAX", factor=0.5)
REPORT = window("R", {"I": "j", "A": "j", "i": "j", "v": "q", "T": "q", "X": "q", "t": "q"}, 0, SYMBOLS + "vAXit", factor=0.5)
GRAMMAR = (INSULT @ THREATEN @ TARGET @ NEGATE @ REPORT).numbered()


class Model:
    """Weights of words and of stems (word beginnings), and of the summed outputs."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights
        self.lengths = sorted({len(s) for s in stems}, reverse=True)

    def insult(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        if not w:
            for n in self.lengths:
                if len(word) >= n and (w := self.stems.get(word[:n], 0.0)):
                    break
        return w

    def features(self, text: str | None) -> list[float]:
        """Sums of each output over all clauses of the text, on a log scale."""
        low = (text or "").lower()
        found = {w: x for w in set(_WORD.findall(low)) if (x := self.insult(w) or CUES.get(w) == "T")}
        sums = dict.fromkeys(OUTPUTS, 0.0)
        if found:
            arcs, start = GRAMMAR.arcs, GRAMMAR.start
            for clause in _CLAUSE.split(low):
                words = _WORD.findall(clause)
                if found.keys().isdisjoint(words):
                    continue
                state = start
                for w in words:
                    x = found.get(w)
                    symbol = CUES.get(w, "O") if x is None or x is True else "I"
                    state, out, factor = arcs[state, symbol]
                    if out in sums:
                        sums[out] += factor * (x if symbol == "I" else THREAT)
        return [math.log1p(sums[o]) for o in OUTPUTS]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


PRIOR = np.array([2.0, 2.2, 0.7, 0.7, 0.7, 1.0, 1.5, 0.3, 0.3, -4.0])


def lexemes(texts: DataFrame) -> DataFrame:
    """From texts(text, label): (lexeme, toxic, clean, contexts).

    Document counts of words and stems by label, and the number of distinct words that they
    follow in toxic documents; copies of a text share contexts, so they prove little. The texts
    are the bounded sample of train, and so are the contexts of a word.
    """

    def run(batches):
        for b in batches:
            toxic, clean, ctx = defaultdict(int), defaultdict(int), defaultdict(set)
            for t, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                before, last = defaultdict(set), ""
                for w in _WORD.findall((t.as_py() or "").lower()):
                    if len(w) > 2:
                        before[w].add(last)
                    last = w
                seen = defaultdict(set)
                for w, c in before.items():
                    seen[w] |= c
                    for n in STEMS:
                        if len(w) > n:
                            seen[w[:n] + "*"] |= c
                count = toxic if label else clean
                for x, c in seen.items():
                    count[x] += 1
                    if label:
                        ctx[x].update(zlib.crc32(v.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF for v in c)
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64()), pa.array([list(ctx[n]) for n in names], pa.list_(pa.int32()))], names=["lexeme", "toxic", "clean", "ctx"])

    parts = texts.select("text", "label").mapInArrow(run, "lexeme string, toxic long, clean long, ctx array<int>")
    return parts.groupBy("lexeme").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.size(F.array_distinct(F.flatten(F.collect_list("ctx")))).alias("contexts"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, label), label 1 toxic and 0 clean.

    A word or stem enters the lexicon if toxic documents hold it far more often than chance
    allows at the number of lexemes tried; its weight is its log odds. Takes at most `sample`
    documents of a label, by hash. Null labels and ids teach nothing; an id labelled both
    ways counts as toxic. Without labels the fixed lists and prior weights judge alone.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = one_per_bucket(known, ["label"], "doc_id", sample).select("doc_id", "label")
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one text for an id, however many rows repeat it, so that the sample stays bounded
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")
    size = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    nt, nc = size.get(1, 0), size.get(0, 0)
    words, stems = dict.fromkeys(INSULTS, 3.0), {}
    if nt and nc:
        counted = stored(lexemes(texts).where(F.col("toxic") >= SUPPORT), shared_dir(docs.sparkSession), "lexemes")
        tried = counted.count() + 1
        # occurrences in different contexts count, up to three a document; if they fell on
        # documents at random, all of them would be toxic with this log probability
        chance = F.least(3 * F.col("toxic"), "contexts") * math.log(nt / (nt + nc))
        sure = counted.where((chance <= -math.log(tried) - 2) & (F.col("clean") <= 0.01 * F.col("toxic")))
        odds = F.log((F.col("toxic") + 0.5) / (nt + 1)) - F.log((F.col("clean") + 0.5) / (nc + 1))
        for r in sure.select("lexeme", odds.alias("w")).orderBy("lexeme").collect():
            (stems if r.lexeme.endswith("*") else words)[r.lexeme.rstrip("*")] = float(r.w)
    model = Model(words, stems, PRIOR)
    if nt and nc:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([shared.value.features(t.as_py()) for t in b.column(0)], pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

        got = texts.mapInArrow(run, "x array<double>, label int").groupBy("x", "label").agg(F.count("*").alias("n")).collect()
        x = np.repeat(np.array([r.x for r in got]), [r.n for r in got], axis=0)
        y = np.repeat(np.array([r.label for r in got], float), [r.n for r in got])
        order = np.lexsort([*x.T, y])
        model.weights = np.maximum(fit_logistic(x[order], y[order], PRIOR, strength=0.1), np.r_[np.zeros(len(OUTPUTS)), -50])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text of docs(doc_id, text); null counts as empty.

    Repeated rows keep a row each, with equal scores; very long texts are read clause by clause;
    extra columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Train on the labels outside the held-out fold and score all documents.

    Returns doc_id, held_out (false without an id), score, predicted (1 from 0.5 on, so a tie is
    toxic), a row for each row of docs; for odd rows see score and train.
    """
    fold = remainder(F.col("doc_id"), folds)
    got = score(docs, train(docs, labels.where(fold != held)))
    return got.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under `threshold`, with all their columns.

    Nulls, empty and long texts and repeated rows are scored as by score; columns of any name go
    along; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in text], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
