import json

from pyspark.sql import functions as F

from newsloom.functions import payloads


def test_get_path(evaluate):
    doc = '{"a":{"0":"zero","l":[10,{"k":"v"},[1,2]]},"q\'s":5}'
    cases = [("a.0", "zero"), ("a.l.1.k", "v"), ("a.l.-1.0", "1"), ("a.l.-4", None), ("a.l.3", None), ("a.l.k", None), ("a.x.y", None), ("q's", "5"), ("a.l. 0 ", "10"), ("a.l.+1.k", "v")]
    found = payloads.get_path(F.try_parse_json("d"), F.col("p"))
    assert evaluate([(doc, path) for path, _ in cases], "d string, p string", payloads.value_text(found)) == [want for _, want in cases]
    whole = payloads.value_text(payloads.get_path(F.try_parse_json("d"), F.col("p")))
    assert evaluate([("[1,2]", "$"), ("[1,2]", ""), ("[1,2]", None), ("no json", "$")], "d string, p string", whole) == ["[1,2]"] * 3 + [None]


def test_values(evaluate):
    docs = ['"x"', '""', "0", "0.0", "1.5", "true", "false", "null", "[]", "[0]", "{}", '{"a":1}', '"false"', '"0"']
    value = F.try_parse_json("d")
    got = evaluate([(d,) for d in docs], "d string", payloads.value_text(value), payloads.has_value(value))
    assert [g[1] for g in got] == [bool(v) for v in ("x", "", 0, 0.0, 1.5, True, False, None, [], [0], {}, {"a": 1}, "false", "0")]
    assert [g[0] for g in got][2:8] == ["0", "0.0", "1.5", "True", "False", None]
    numbers = ["1", "-1.0", "1.50", "12345678901234567890", "1e3", "1700000000"]
    assert evaluate([(n,) for n in numbers], "d string", payloads.value_text(value)) == [str(json.loads(n)) for n in numbers]


def test_pick_field(evaluate):
    rows = [(["b", "a"],), (["c"],), ([],), (None,)]
    assert evaluate(rows, "k array<string>", payloads.pick_field(F.col("k"), ("a", "b"))) == ["a", None, None, None]
