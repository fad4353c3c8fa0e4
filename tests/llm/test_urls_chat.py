import hashlib
import json
import random

from emberlog.llm import chat, urlfilter
from emberlog.llm.queries import URL_RULES

URLS = [
    (1, "http://a.example.org/es/x"), (2, "https://EXAMPLE.org/en/12?q"), (3, "http://example.org/en/2"), (4, "http://x.com/fr/1#y"), (5, "http://com/de/"), (6, "http://telecom/de/1"),
    (7, "http://x.com/DE/1"), (8, None), (9, "no scheme"), (10, "://org"), (11, "http://org?x://y.com/de/"), (12, "http://notexample.org/es/"), (13, "http://x.com"), (14, ""), (1, "http://a.example.org/es/x"),
    (15, "http://x.net/" + "a" * 100_000), (19, "http://" + "a." * 50_000 + "org/x"), (20, "http://" + "b" * 1_000_000 + "/de/1"), (21, "http://a..com/fr/"), (22, "http://.com/fr/"), (16, "http://x.org./p"), (None, "http://É.ORG/é"), (17, "http://user@x.com/de/1\n/z"), (18, "http:///de/1"),
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min([i for i, c in enumerate(rest) if i >= cut and c in "?#"], default=len(rest))
        path = rest[cut:end]
    best, verdict = None, "allow"
    for v, r in URL_RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best)):
            best, verdict = r, v
    return host, path, best, verdict


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, host string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in urlfilter.filter_urls(df, URL_RULES).collect())
    assert got == sorted((str(i), *map(str, brute(u)[:3]), brute(u)[3]) for i, u in URLS)
    assert urlfilter.filter_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(df, [], default="block").collect()} == {"block"}


def test_collisions_are_told_apart(spark):
    name, _ = urlfilter.build_index(spark, [("block", f"h{i}.net/") for i in range(50)])
    index = urlfilter.open_index(name)
    index = index._replace(rules=index.rules * 0 + 7)  # all digests collide
    same = urlfilter.xxhash.xxh64_intdigest
    try:
        urlfilter.xxhash.xxh64_intdigest = lambda k: 7
        got = urlfilter.probe(index, ["h3.net/", "h99.net/"])
    finally:
        urlfilter.xxhash.xxh64_intdigest = same
    assert got[0] >= 0 and got[1] == -1


def test_long_hosts_cost_no_more_than_the_rules():
    bounds = urlfilter.Bounds(3, 15)
    assert urlfilter.domains("x." * 500_000 + "example.org", bounds) == ["org", "example.org", "x.example.org"]
    assert urlfilter.domains("example.org", bounds) == ["org", "example.org"]
    assert urlfilter.domains("a" * 16, bounds) == urlfilter.domains("", bounds) == []


def test_many_rules_equal_a_scan(spark):
    rng = random.Random(5)
    name = lambda n: ".".join(rng.choice(["a", "b", "cc", "org"]) for _ in range(n))
    rules = [(rng.choice(["allow", "block"]), f"{name(rng.randint(1, 4))}/{'xy'[: rng.randint(0, 2)]}") for _ in range(300)]
    urls = [(i, f"http://{name(rng.randint(1, 6))}{rng.choice(['', '/', '/x', '/xy', '/xyz', '/y'])}") for i in range(500)]
    verdicts = {}
    for v, r in rules:
        verdicts[r] = "block" if "block" in (v, verdicts.get(r)) else "allow"
    want = {}
    for i, u in urls:
        host, slash, path = u[7:].partition("/")
        fits = [r for r in verdicts if slash and ("." + host).endswith("." + r.partition("/")[0]) and path.startswith(r.partition("/")[2])]
        best = max(fits, key=lambda r: (len(r), r), default=None)
        want[i] = (best, verdicts.get(best, "allow"))
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()} == want


MSG = "conv_id long, turn long, role string, text string, json string"


def expected(rows):
    """The rows of format_conversations, by a walk over the turns."""
    same = {}
    for conv, turn, role, text, _ in rows:
        at = (conv, turn, role, text or "")
        same[at] = same.get(at, 0) + 1
    order = lambda t: json.dumps(t, ensure_ascii=False).encode()
    asks, answers, out = {}, {}, []
    for (conv, turn, role, text), n in same.items():
        if role == "user":
            asks.setdefault((conv, turn), []).append((text, n))
        elif role == "assistant":
            answers.setdefault((conv, None if turn is None else turn - 1), []).append((text, n))
        else:
            body = {k: v for k, v in (("content", text), ("role", role)) if v is not None}
            out.append((conv, None, 0, turn, "message", None, n, body))

    def level(conv, turn):
        before = next((t for t in (turn - 1, turn - 2) if (conv, t) in asks), None)
        return 0 if before is None else level(conv, before) + 1

    def add(conv, turn, call, said, content, status, n):
        body = {}
        if said is not None:
            body |= {"arguments": {"prompt": said, "turn": turn}, "name": "reply"}
        if content is not None:
            body["result"] = content
        own = None if call is None else str(call)
        if status == "repeated":
            own += "~" + hashlib.md5(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]
        if own is not None:
            body["id"] = own
        valid = None if said is None else bool(said.strip()) and turn is not None and len(json.dumps(said, ensure_ascii=False)) <= chat.PROMPT + 2
        depth = level(conv, call) if conv is not None and (conv, call) in asks and call is not None else 0
        out.append((conv, own, depth, turn if said is not None else None, status, valid, n, body))

    for key in asks.keys() | answers.keys():
        conv, call = key
        if None in key:
            for text, n in asks.get(key, []):
                add(conv, call, call, text, None, "no_result", n)
            for text, n in answers.get(key, []):
                add(conv, None, call, None, text, "no_call", n)
            continue
        mine, theirs = sorted(asks.get(key, []), key=lambda x: order(x[0])), sorted(answers.get(key, []), key=lambda x: x[0].encode())
        if mine:
            add(conv, call, call, mine[0][0], theirs[0][0] if theirs else None, "linked" if theirs else "no_result", mine[0][1])
        elif theirs:
            add(conv, None, call, None, theirs[0][0], "no_call", theirs[0][1])
        for text, n in mine[1:]:
            add(conv, call, call, text, None, "repeated", n)
        for text, n in theirs[1:]:
            add(conv, None, call, None, text, "repeated", n)
    return out


def test_conversations_equal_a_walk(spark):
    rng = random.Random(8)
    rows = [
        (1, 0, "user", 'say "hi"\n\\ \u0007', ""), (1, 1, "assistant", "hé", ""), (1, 2, "user", "", ""), (1, 3, "assistant", None, ""), (1, 4, "user", "open", ""),
        (2, 0, "system", "be nice", ""), (2, 0, "system", "be nice", ""), (2, 0, "system", "be short", ""), (2, 2, "assistant", "unasked", ""), (2, 3, None, None, ""), (2, 4, "tool", "t", ""),
        (None, 0, "user", "lost", ""), (None, 1, "assistant", "lost", ""), (3, None, "user", "x", ""), (3, None, "assistant", "y", ""), (3, None, "assistant", "y", ""), (None, None, "system", "s", ""),
        (4, 0, "user", "b", ""), (4, 0, "user", "a", ""), (4, 0, "user", "a", ""), (4, 1, "assistant", "z", ""), (4, 1, "assistant", "y", ""), (5, 0, "user", "x" * 50_000, ""),
    ]
    rows += [(6, t, "user" if t % 2 else "assistant", f"t{t}", "") for t in range(60)] + [(7, t, "user", f"t{t}", "") for t in range(40)]
    rows += [(rng.randint(8, 12), rng.randint(0, 30), rng.choice(["user", "user", "assistant", "system"]), rng.choice("abc"), "") for _ in range(200)]
    got = chat.format_conversations(spark.createDataFrame(rows, MSG)).collect()
    text = lambda b: json.dumps(b, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    mine = sorted(str((r.conv_id, r.call_id, r.level, r.place, r.status, r.valid, r.copies, json.loads(r.json))) for r in got)
    assert mine == sorted(str((*x[:7], json.loads(text(x[7])))) for x in expected(rows))
    assert all(r.json == text(json.loads(r.json)) for r in got)
    assert {r.level for r in got if r.conv_id == 7} == set(range(40))
    assert chat.format_conversations(spark.createDataFrame([], MSG)).count() == 0


def test_crowded_identifiers_equal_a_walk(spark):
    """Identifiers that hold over 1000 rows go a way of their own, and meet as all others do."""
    rows = [(1, 1, "user", f"t{i % 1100}", "") for i in range(1300)] + [(1, 2, "assistant", f"r{i % 3}", "") for i in range(5)]
    rows += [(1, 3, "user", "next", ""), (2, 1, "user", "even", ""), (2, 2, "assistant", "yes", ""), (None, 1, "user", "lost", "")]
    rows += [(3, 0, "user", "asks", "")] + [(3, 1, "assistant", f"a{i % 1050}", "") for i in range(1200)]
    got = chat.format_conversations(spark.createDataFrame(rows, MSG)).collect()
    mine = sorted(str((r.conv_id, r.call_id, r.level, r.place, r.status, r.valid, r.copies, json.loads(r.json))) for r in got)
    assert mine == sorted(str((*x[:7], json.loads(json.dumps(x[7], sort_keys=True)))) for x in expected(rows))


def test_levels(spark):
    call = "conv_id long, call_id string, name string, args map<string,string>, after array<string>, place long"
    schemas = {"f": {"n": ("integer", True), "s": ("string", False), "x": ("number", False), "b": ("boolean", False)}}
    rows = [
        (1, "a", "f", {"n": "1"}, ["b"], 0), (1, "b", "f", {"n": "01"}, ["c", "c"], 1), (1, "c", "f", {"n": "2", "s": '"t"'}, [], 2), (1, "d", "g", {}, ["gone"], 3),
        (2, "x", "f", {"n": "1", "z": "1"}, ["y"], 0), (2, "y", "f", {"n": "1", "x": "1.5e3"}, ["x"], 1), (2, "w", "f", {"n": "1", "b": "yes"}, ["y"], 2), (2, "v", "f", {"s": '" "', "n": "3"}, None, 3),
        (3, "p", "f", None, [], 0), (3, "q", "f", {"n": "5"}, ["p"], 1),
    ]
    res = spark.createDataFrame([(1, "a", "r")], "conv_id long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in chat.link_calls(spark.createDataFrame(rows, call), res, schemas).collect()}
    assert {k: v.level for k, v in got.items()} == {(1, "a"): 2, (1, "b"): 1, (1, "c"): 0, (1, "d"): 0, (2, "x"): None, (2, "y"): None, (2, "w"): None, (2, "v"): 0, (3, "p"): 0, (3, "q"): 1}
    assert {k: v.valid for k, v in got.items()} == {(1, "a"): True, (1, "b"): False, (1, "c"): True, (1, "d"): False, (2, "x"): False, (2, "y"): True, (2, "w"): False, (2, "v"): False, (3, "p"): False, (3, "q"): True}


def test_levels_of_long_chains_and_ladders(spark):
    """Chains, calls that wait for two others, and cycles, against levels by recursion."""
    rng, rows, after = random.Random(3), [], {}
    for conv in range(12):
        n = rng.choice([1, 5, 40, 90])
        for i in range(n):
            waits = [f"c{i - 1}"] if conv < 6 and i else [f"c{rng.randrange(n)}" for _ in range(rng.choice([0, 0, 1, 1, 2]))]
            after[conv, f"c{i}"] = waits
            rows.append((conv, f"c{i}", "f", {}, waits, i))
    # all of a's edges lead into a cycle, through one another
    for name, waits in (("a", ["b", "c", "d"]), ("b", ["c"]), ("c", ["d"]), ("d", ["b"])):
        after[99, name] = waits
        rows.append((99, name, "f", {}, waits, ord(name)))
    call = "conv_id long, call_id string, name string, args map<string,string>, after array<string>, place long"
    level = {k: 0 if not w else None for k, w in after.items()}
    while True:
        more = {k: 1 + max(level[k[0], x] for x in w) for k, w in after.items() if level[k] is None and all(level[k[0], x] is not None for x in w)}
        if not more:
            break
        level |= more
    none = spark.createDataFrame([], "conv_id long, call_id string, content string")
    assert {(r.conv_id, r.call_id): r.level for r in chat.link_calls(spark.createDataFrame(rows, call), none, {"f": {}}).collect()} == level
