import hashlib
from pathlib import Path

import pytest

from emberlog.llm import alignment
from emberlog.llm.queries import TOKENIZERS

PATHS = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not Path(PATHS[0]).exists(), reason="no vocabularies here")
SCHEMA = "doc_id long, text string, pairs string, row long"


def brute(rows):
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    to_byte, extra = {}, 256
    for x in range(256):
        shown = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
        to_byte[chr(x) if shown else chr(extra)] = x
        extra += not shown
    docs, counts = [], {}
    for doc_id, text, *_ in rows:
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        spans = []
        for ts in (ba, bb):
            at, out = 0, []
            for t in ts:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        links = [(ia[i], ib[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for c in cuts:
            groups.append([",".join(str(i) for i, (s, e) in zip(ids, sp) if start <= s and e <= c) for ids, sp in ((ia, spans[0]), (ib, spans[1]))])
            start = c
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
        docs.append((doc_id, ia, ib, links, (len(groups), hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest())))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(((i, len(ia), len(ib), g[0] if g else 0, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), g[1] if g else "") for i, ia, ib, links, g in docs), key=str)


ROWS = [
    (1, "Hello world, antidisestablishmentarianism!", "clash", 0),
    (2, "Hello world", "", 0),
    (2, "Hello world", "", 0),
    (3, "", "", 0),
    (4, None, "", 0),
    (None, "Grüße aus Köln; 東京 and 🙂🙂", "", 0),
    (5, "has ▁ the mark", "", 0),
    (6, "<|endoftext|> <s> </s> <unk> <0x41>", "", 0),
    (7, "  leading\n\n\ttabs and   blanks  ", "", 0),
    (8, "\x00\x01 control", "", 0),
    (9, " ", "", 0),
    (10, "the the the The THE " * 40, "", 0),
]


@pytest.mark.parametrize("most_pairs", [1_000_000, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, most_pairs):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = alignment.align_documents(df, *PATHS, most_pairs=most_pairs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_runs_are_cut_by_size(monkeypatch):
    a, b = alignment.byte_level(PATHS[0]), alignment.pieces(PATHS[1])
    texts = [r[1] for r in ROWS]
    whole = alignment.align(texts, a, b)
    monkeypatch.setattr(alignment, "RUN", 30)
    runs = list(alignment._runs(texts))
    assert len(runs) > 3 and runs[0][0] == 0 and runs[-1][1] == len(texts)
    parts = [alignment.align(texts[i:j], a, b) for i, j in runs]
    assert [x for p in parts for x in p[0].T.tolist()] == whole[0].T.tolist()
    assert [x for p in parts for x in p[1]] == whole[1]
    assert [x.tolist() for p in parts for x in p[2]] == [x.tolist() for x in whole[2]]


def test_ranks_give_the_ids_of_the_library():
    import tokenizers

    a = alignment.byte_level(PATHS[0])
    whole = tokenizers.Tokenizer.from_file(PATHS[0])
    whole.encode_special_tokens = True
    texts = [r[1] or "" for r in ROWS] + [" " * 3000, "a" * 5000, "don't I'll  WE'VE 1234567", "　  x"]
    assert a.encode(texts) == [whole.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_empty_table_and_links(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert alignment.align_documents(df, *PATHS).collect() == []
    table = alignment.link_table(spark.createDataFrame(ROWS, SCHEMA), *PATHS).collect()
    assert len({(r.a, r.b) for r in table}) == len(table) and any(r.best for r in table)
