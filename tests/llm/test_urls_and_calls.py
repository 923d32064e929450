import json

from tests.llm.conftest import rows
from turnwise.llm import tool_calls as tc
from turnwise.llm import url_filter as uf


def judged(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr(
        "*", "'h' AS host", "'p' AS path", "'r' AS rule"
    )
    return {r["page_id"]: r for r in uf.filter_urls(pages).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("http://b.example.com/de/", "b.example.com", "/de/", "example.com/de/", "block"),
        ("x://a.org/fr/?y", "a.org", "/fr/", "org/fr/", "allow"),
        ("http://net?/", "net", "", None, "allow"),
        ("http://net", "net", "", None, "allow"),
        ("http://net/", "net", "/", "net/", "block"),
        ("//a.net/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
        ("http://ÀB.net/", "Àb.net", "/", "net/", "block"),
        ("http://a.org#frag/fr/", "a.org", "", None, "allow"),
    ]
    found = judged(spark, [c[0] for c in cases])
    for i, (_, *want) in enumerate(cases):
        assert [found[i][n] for n in ("host", "path", "rule", "verdict")] == want, cases[i]


def test_vocabulary_counts_between_boundaries(spark):
    urls = [
        "http://casino.example.com/", "http://casinos.example.com/", "http://my-CASINO_x.com/", "http://cheap.com/",
        "http://cheap-cheap.com/", "http://cheap.com/pills", "http://cheappills.com/", "http://écasino.com/",
        "http://cheap.net/pills", "http://x.example.net/en/casino",
    ]
    found = judged(spark, urls)
    want = ["block", "allow", "block", "allow", "allow", "block", "allow", "block", "block", "allow"]
    assert [found[i]["verdict"] for i in range(len(urls))] == want
    assert (found[5]["strict_hits"], found[5]["soft_hits"]) == (0, 2)


def test_repeated_and_missing_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id bigint, url string")
    assert rows(uf.filter_urls(pages), "page_id", "verdict") == [(1, "block"), (1, "block"), (None, "allow")]
    assert uf.filter_urls(pages.where("false")).count() == 0
    assert uf.hits("casino", uf.automaton([], [])) == (0, 0)


SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 9}}, "additionalProperties": False}}
MESSAGE = "conv_id bigint, turn bigint, role string, kind string, call_id string, name string, content string"


def formatted(spark, messages, needs=()):
    given = spark.createDataFrame(messages, MESSAGE)
    wanted = spark.createDataFrame(list(needs), "conv_id bigint, call_id string, needed string")
    return tc.format_tool_calls(given, wanted, SCHEMAS)


def order(df):
    ordered = sorted(df.collect(), key=lambda r: (r["conv_id"], r["order_turn"], r["order_hop"], r["turn"]))
    return [(r["kind"], r["call_id"]) for r in ordered]


def test_links_faults_and_canonical_json(spark):
    messages = [
        (1, 0, "user", "text", None, None, "é \"q\"\n"),
        (1, 1, "assistant", "call", "c1", "add", '{"a": 1}'),
        (1, 2, "tool", "result", "c1", None, "2"),
        (1, 3, "assistant", "call", "c2", "add", '{"a": 10}'),
        (1, 4, "assistant", "call", "c3", "sub", "{}"),
        (1, 5, "tool", "result", "c9", None, None),
        (1, 6, "assistant", "call", None, "add", "not json"),
        (1, 7, "assistant", "call", "c4", "add", None),
        (1, 8, "assistant", "call", "c5", "add", '{"b": 1, "a": true}'),
        (2, 0, "tool", "result", "c1", None, "other conversation"),
        (1, 9, "assistant", "call", "c6", "add", '{"a": 1}'),
        (1, 9, "assistant", "call", "c6", "add", '{"a": 1}'),
        (None, None, None, None, None, None, None),
    ]
    found = formatted(spark, messages)
    got = {(r["conv_id"], r["turn"]): r for r in found.collect()}
    assert found.count() == len(messages)
    assert [got[1, t]["link"] for t in range(8)] == [None, "linked", "linked", "unanswered", "unanswered", "orphan", "unanswered", "unanswered"]
    assert got[2, 0]["link"] == "orphan" and got[1, 9]["link"] == "unanswered"
    assert got[1, 1]["error"] is None and got[1, 3]["error"] == "$.a: above maximum"
    assert got[1, 4]["error"] == "unknown tool" and got[1, 6]["error"] == "$: not JSON"
    assert got[1, 7]["error"] == "$: not object" and got[1, 8]["error"] == "$.a: not integer"
    assert got[1, 1]["message"] == '{"arguments":{"a":1},"id":"c1","name":"add","role":"assistant"}'
    assert json.loads(got[1, 0]["message"]) == {"content": "é \"q\"\n", "role": "user"}
    assert formatted(spark, []).count() == 0


def test_order_follows_links_and_needs(spark):
    messages = [
        (1, 0, "tool", "result", "a", None, "r"),
        (1, 1, "assistant", "call", "b", "add", "{}"),
        (1, 2, "assistant", "call", "a", "add", "{}"),
        (1, 3, "tool", "result", "b", None, "r"),
        (1, 4, "user", "text", None, None, "t"),
    ]
    found = order(formatted(spark, messages, [(1, "b", "a"), (1, "b", "nowhere"), (1, "a", "a")]))
    places = {item: n for n, item in enumerate(found)}
    assert places["call", "a"] < places["result", "a"] < places["call", "b"] < places["result", "b"]
    circle = formatted(spark, messages, [(1, "b", "a"), (1, "a", "b")])
    assert circle.count() == 5


def test_a_circle_adds_no_round_for_other_conversations(spark, monkeypatch):
    circle = [(1, 0, "a"), (1, 1, "b")]
    chain = [(2, t, f"m{t}") for t in range(6)]
    schema = "conv_id bigint, turn bigint, message_id string"
    wanted = [(1, "a", "b"), (1, "b", "a"), *[(2, f"m{t}", f"m{t + 1}") for t in range(5)]]
    needs = spark.createDataFrame(wanted, "conv_id bigint, message_id string, needed string")
    made, real = [], tc.written
    monkeypatch.setattr(tc, "written", lambda df, name: made.append(name) or real(df, name))
    counts, orders = [], []
    for others in (0, 40):
        made.clear()
        messages = circle + chain + [(100 + i, t, f"x{t}") for i in range(others) for t in range(3)]
        found = tc._ordered(spark.createDataFrame(messages, schema), needs)
        keys = {(r["conv_id"], r["message_id"]): (r["order_turn"], r["order_hop"]) for r in found.collect()}
        assert len(keys) == len(messages)
        chained = [keys[2, f"m{t}"] for t in range(6)]
        assert chained == sorted(chained, reverse=True) and len(set(chained)) == 6
        counts.append(len(made))
        orders.append({k: v for k, v in keys.items() if k[0] < 100})
    assert counts[0] == counts[1] and orders[0] == orders[1]


def test_derived_calls_are_linked(spark):
    turns = [(7, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(6)] + [(8, 0, None, None)]
    messages, needs = tc.conversation_calls(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    found = tc.format_tool_calls(messages, needs, tc.SCHEMAS)
    links = {r["turn"]: r["link"] for r in found.where("conv_id = 7").collect()}
    assert links == {0: None, 1: "linked", 2: "linked", 3: "linked", 4: "linked", 5: "unanswered"}
    assert {r["error"] for r in found.where("kind = 'call'").collect()} == {None}
