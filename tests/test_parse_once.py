"""What is read of a JSON line is computed once, and odd lines read as ever."""

from pyspark.sql import functions as F

from emberlog.operators import parse


def _steps(t) -> str:
    return t._jdf.queryExecution().optimizedPlan().toString()


def test_members_are_cut_once(spark):
    """Repeated keys and values that look missing are rare; their members were cut again for each key and each use."""
    lines = spark.createDataFrame([("{}", None)], "text string, default_service string")
    one = lines.select(parse.json_object(F.col("text")).alias("m"))
    assert _steps(one).count("regexp_extract_all") == 1
    assert _steps(one).count("from_json") <= 4  # the whole, its keys, the check, and each member
    # the line, its Kubernetes field and the labels: to read each, and to find values that count as missing
    assert _steps(parse.with_parsed_json(lines)).count("regexp_extract_all") <= 8
    assert _steps(parse.with_parsed_json(lines)).count("array_position") == 0


def test_odd_lines(spark):
    given = {
        None: None, "": None, " \x1c": None, "{broken": "error", "{'a':1}": "error", '{"a":1}],[{"b":2}': "error", "[]": "error", "null": "error",
        '{"msg":null,"LOG":"z","log":"y"}': (None, "{...}", {"LOG": "z"}), '{"LOG":"z","Log":"y"}': (None, "z", {"LOG": "z", "Log": "y"}), '{"LOG":"z","log":"y","MSG":"a"}': (None, "a", {"LOG": "z", "MSG": "a"}),
        '{"level":"0","app":"s","lvl":"x"}': ("0", "{...}", {}), '{"level":0,"lvl":"x","app":false}': (None, "{...}", {}), '{"a":1,"msg":"o","a":[2,"x"],"app":"0","msg":"n"}': (None, "n", {"a": '[2,"x"]'}),
    }
    # twice each: repeated lines stay
    rows = [(i, text, None) for i, text in enumerate([*given, *given])]
    got = parse.with_parsed_json(spark.createDataFrame(rows, "i long, text string, default_service string")).orderBy("i").collect()
    for r, want in zip(got, [*given.values(), *given.values()], strict=True):
        p = r.parsed
        seen = None if p is None else "error" if p.parse_error else (p.level, "{...}" if p.message == r.text else p.message, p.extra)
        assert seen == want, r.text
    assert got[-1].parsed.service == "0" and got[-2].parsed.service is None and got[-3].parsed.service == "s"
