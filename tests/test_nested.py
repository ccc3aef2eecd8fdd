import json

from corvane.operators.nested import NodeKind, containers, label, linked_table, link_by_containment, node_table

Q = NodeKind("qs", "q", {"n": "id.n"})
R = NodeKind("rs", "r", {"t": "t", "d": "info.d"})


def rec(q):
    return json.dumps({"a": {"qs": {"q": q}}})


def test_labels_follow_ancestry():
    nodes = label({"qs": {"q": [{"rs": {"r": [1, 2]}}, None, {"rs": {"r": 3}}]}}, {("qs", "q"): "q", ("rs", "r"): "r"})
    assert [n.pos for n in nodes["q"]] == [0, 1, 2] and [n.pos for n in nodes["r"]] == [0, 1, 0]
    owners = containers(nodes["r"], nodes["q"])
    assert [o.pos for o in owners] == [0, 0, 2]
    for r, q in zip(nodes["r"], owners):
        assert q.pre < r.pre and q.post > r.post


def test_innermost_parent_of_nested_kinds():
    nodes = label({"qs": {"q": {"qs": {"q": {"rs": {"r": 1}}}, "rs": {"r": 2}}}}, {("qs", "q"): "q", ("rs", "r"): "r"})
    inner, outer = nodes["q"][1], nodes["q"][0]
    assert containers(nodes["r"], nodes["q"]) == [inner, outer]


def test_linked_rows(spark):
    rows = [
        (1, rec([{"id": {"n": 7}, "rs": {"r": [None, {"t": {"#text": "x", "@l": "fr"}, "info": {"d": "d1"}}, {"t": {"@nil": "true"}}]}}, None]), "z"),
        (2, rec({"id": {"n": "8"}, "rs": {"r": {"t": "lone"}}}), "z"),
        (3, rec([])[:-3], "z"),
        (4, "", "z"),
        (5, None, "z"),
        (6, "[" * 100_000, "z"),
        (7, json.dumps({"rs": {"r": {"t": "no parent"}}}), "z"),
        (None, rec({"id": None, "rs": None}), "z"),
    ]
    df = spark.createDataFrame(rows, "k bigint, payload string, pre string")
    got = [tuple(r) for r in linked_table(df, "k", "payload", R, Q).select("k", "parent_pos", "pos", "t", "d", "parent_n").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, None, None, "7"), (1, 0, 1, "x", "d1", "7"), (1, 0, 2, None, None, "7"), (2, 0, 0, "lone", None, "8")], key=str)
    tables = node_table(df, "k", "payload", R), node_table(df, "k", "payload", Q)
    joined = [tuple(r) for r in link_by_containment(*tables, "k").select("k", "parent_pos", "pos", "t", "d", "parent_n").collect()]
    assert sorted(joined, key=str) == sorted(got, key=str)


def test_empty(spark):
    assert linked_table(spark.createDataFrame([], "k bigint, payload string"), "k", "payload", R, Q).count() == 0


def test_long_record(spark):
    many = rec([{"id": {"n": i}, "rs": {"r": [{"t": "t" * 50}] * 3}} for i in range(3000)])
    assert linked_table(spark.createDataFrame([(1, many)], "k bigint, payload string"), "k", "payload", R, Q).count() == 9000
