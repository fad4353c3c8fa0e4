import random
import zlib

import numpy as np

from emberlog.llm import langid, quality, toxicity

DOC = "doc_id long, text string, lang string, source string, score double"
VOCAB = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod".split(), "bb": "der schnelle braune fuchs springt über den faulen hund heute".split(), "cc": "naïve café élan garçon déjà voilà crème brûlée forêt hôtel".split()}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = sorted(VOCAB)[i % 3]
        rows.append((i, " ".join(rng.choice(VOCAB[k]) for _ in range(rng.randint(3, 60))).capitalize() + ".", k, "src", 9.0))
    return rows


ODD = [(9000, None, "aa", None, None), (9001, "", None, None, None), (9002, " 123 !!", "bb", None, None), (9004, "² ½ Ⅷ", None, None, None), (None, "der schnelle hund", "bb", None, None), (9003, "der faule hund " * 20_000, None, None, None), (9003, "der faule hund " * 20_000, None, None, None)]


def held(i, mod, r):
    return i is not None and zlib.crc32(str(i).encode()) % mod == r


def test_language(spark):
    rows = corpus() + ODD
    got = langid.identify(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in corpus()}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.98 * len(tested) > 0
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r.lang_pred for r in got if r.doc_id is None or r.doc_id >= 9000}
    assert odd == {9000: "und", 9001: "und", 9002: "und", None: "bb", 9003: "bb", 9004: "und"}


def test_language_equals_plain_compression(spark):
    import zstandard

    rows = corpus(90, 4) + ODD
    df = spark.createDataFrame(rows, DOC)
    dictionaries = langid.train(df)

    def size(text, content):
        data = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
        coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(coder.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK))

    for r in langid.predict(df.select("doc_id", "text"), dictionaries).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in text or "")
        else:
            assert r.lang_pred == min(sorted(dictionaries), key=lambda k: size(text, dictionaries[k]))


def test_quality_equals_plain_compression(spark):
    import math

    import zstandard

    rows, bad = labelled(lambda t, rng: t.upper(), 120)
    model = quality.train(spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, 1 - b) for i, b in bad], "doc_id long, label int"))
    for text in [r[1] for r in rows[:40]] + ["", "x" * 10_000, "ÀÉ " * 3000]:
        data, sizes = text.encode(), []
        for content in (model.bad, model.good):
            coder = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK)))
        z = model.weights[0] * 100 * (sizes[0] - sizes[1]) / (len(data) + quality.PAD) + model.weights[1]
        assert abs(model.score(text) - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-12


def test_many_rows_of_one_labelled_id(spark):
    rows, bad = labelled(lambda t, rng: t.upper(), 60)
    rows += [(0, f"copy {i} of a labelled id", None, None, None) for i in range(3000)]
    labels = spark.createDataFrame([(i, 1 - b) for i, b in bad], "doc_id long, label int")
    assert quality.judge(spark.createDataFrame(rows, DOC), labels).count() == len(rows)
    assert toxicity.judge(spark.createDataFrame(rows, DOC), labels).count() == len(rows)


def test_language_without_training(spark):
    df = spark.createDataFrame([(1, "some words", None, None, None)], DOC)
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0


def labelled(bad, n=300, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i, t, k, s, x in corpus(n, seed):
        flag = int(rng.random() < 0.4)
        rows.append((i, bad(t, rng) if flag else t, k, s, x))
        labels.append((i, flag))
    return rows, labels


def test_quality(spark):
    rows, bad = labelled(lambda t, rng: " ".join(w + rng.choice(["!!", "&&&", "%%%"]) for w in t.split()))
    labels = spark.createDataFrame([(i, 1 - b) for i, b in bad] + [(9000, 0), (None, 1), (5, None)], "doc_id long, label int")
    got = quality.judge(spark.createDataFrame(rows + ODD, DOC), labels).collect()
    assert len(got) == len(rows) + len(ODD)
    truth = {i: 1 - b for i, b in bad}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.95 * len(tested) > 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id, 3, 1) for r in got)
    kept = quality.keep_good(spark.createDataFrame(rows, DOC), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"]
    assert {r.doc_id for r in kept.collect()} & {i for i, b in bad if b} == set()


def test_unlabelled(spark):
    df, none = spark.createDataFrame(ODD, DOC), spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.judge(df, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.judge(df, none).collect()} == {0}
    assert quality.judge(df.limit(0), none).count() == toxicity.judge(df.limit(0), none).count() == 0


def test_toxicity_learns_invented_words(spark):
    def rude(t, rng):
        w = t.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), "grobl" + rng.choice(["ix", "um", "as", "ent"]))
        return " ".join(w)

    rows, labels = labelled(rude)
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, label int")
    got = toxicity.judge(spark.createDataFrame(rows + ODD, DOC), marks).collect()
    truth = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.98 * len(tested) > 0
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (9000, 9001, 9002, 9003, 9004))
    kept = toxicity.drop_toxic(spark.createDataFrame(rows, DOC), marks).collect()
    assert {r.doc_id for r in kept} == {i for i, f in labels if not f}


def test_grammar():
    m = toxicity.Model({"idiot": 3.0}, {"grobl": 3.0}, toxicity.PRIOR)
    at = lambda t: dict(zip(toxicity.OUTPUTS, m.features(t), strict=True))
    assert at("such an idiot")["I"] > 0
    assert at("you are an idiot")["A"] > 0 and at("you are an idiot")["I"] == 0
    assert at("that is not an idiot")["i"] > 0
    assert at("he said an idiot came")["j"] > 0
    assert at("he said so. an idiot came")["I"] > 0  # speech ends with its clause
    assert at("not now, and in any case an idiot")["I"] > 0  # out of the negation's reach
    assert at("groblix")["I"] > 0 and at("grob")["I"] == 0
    assert at("i will kill it")["T"] > 0 and at("never going to kill it")["t"] > 0 and at("he wrote kill it")["q"] > 0
    assert at("kill it")["v"] > 0 and at("kill it")["T"] == 0 and at("i will kill you")["X"] > 0 and at("never kill you")["t"] > 0
    assert at("idiot idiot")["I"] > at("idiot and much later on an idiot")["I"]  # insults in a row weigh more
    assert m.score("you idiot, you idiot") > m.score("he said idiot") > m.score("hello")
    assert m.features(None) == [0.0] * len(toxicity.OUTPUTS)


def clause_by_rules(symbols):
    """What the grammar should write, position by position, from what stands before."""
    out = []
    for i, s in enumerate(symbols):
        f = 1.0
        before = lambda n, c, i=i: any(x in c for x in symbols[max(0, i - n) : i])
        if s == "I" and before(3, "I"):
            f *= 1.25
        if s == "T":
            s, f = ("T", f * 1.5) if before(3, "M") else ("v", f)
        if s == "I" and before(4, "Y"):
            s, f = "A", f * 1.2
        elif s == "Y":
            verbs = [j for j in range(max(0, i - 3), i) if symbols[j] == "T"]
            if verbs and "Y" not in symbols[verbs[-1] : i]:
                s = "X"
        if before(3, "N") and s in "IAvTX":
            s, f = {"I": "i", "A": "i", "v": "O", "T": "t", "X": "t"}[s], f * 0.5
        if before(i, "R") and s in "IAivTXt":
            s, f = "j" if s in "IAi" else "q", f * 0.5
        out.append((s, f))
    return out


def test_composed_grammar_equals_five_in_sequence_and_the_rules():
    rng = random.Random(9)
    parts = (toxicity.INSULT, toxicity.THREATEN, toxicity.TARGET, toxicity.NEGATE, toxicity.REPORT)
    for _ in range(3000):
        symbols = rng.choices(toxicity.SYMBOLS, weights=(3, 3, 1, 3, 1, 0.4, 4), k=rng.randint(1, 18))
        state, factors = symbols, [1.0] * len(symbols)
        for part in parts:
            got = part.run(state)
            state, factors = [s for s, _ in got], [x * f for x, (_, f) in zip(factors, got, strict=True)]
        whole = toxicity.GRAMMAR.run(symbols)
        assert [s for s, _ in whole] == state and np.allclose([f for _, f in whole], factors)
        rules = clause_by_rules(symbols)
        assert [s for s, _ in whole] == [s for s, _ in rules] and np.allclose(factors, [f for _, f in rules]), symbols
