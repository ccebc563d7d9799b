from __future__ import annotations

import pytest

from clickloom.llm import chat_views, url_rules
from clickloom.llm.queries import QUERIES, URL_RULES

from ..conftest import SF


def judged(spark, urls, rules=URL_RULES):
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, weight int")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(got, key=lambda r: r["page_id"])}


def test_host_rules(spark):
    urls = [
        "http://a.NET/x", "http://example.net/en/a", "http://www.example.net/en/", "http://example.net/en", "http://example.net/EN/a",
        "https://b.example.com/de/?q#f", "http://notexample.com/de/", "http://x.org/fr/1", "http://x.org/de/http://y.net/", "http://net", "http://net/",
        "http://x.net:80/", "ftp//no", None, "", "://net/#/en/", "http://a.net?x=/en/", "http://a.b/c\nd?e", "x://y://z.net/",
    ]
    assert list(judged(spark, urls).values()) == [
        ("a.net", "/x", "net/", "block"), ("example.net", "/en/a", "example.net/en/", "allow"), ("www.example.net", "/en/", "example.net/en/", "allow"),
        ("example.net", "/en", "net/", "block"), ("example.net", "/EN/a", "net/", "block"), ("b.example.com", "/de/", "example.com/de/", "block"),
        ("notexample.com", "/de/", None, "allow"), ("x.org", "/fr/1", "org/fr/", "allow"), ("x.org", "/de/http://y.net/", None, "allow"),
        ("net", "", None, "allow"), ("net", "/", "net/", "block"), ("x.net:80", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("net", "/", "net/", "block"), ("a.net", "", None, "allow"), ("a.b", "/c\nd", None, "allow"), ("y:", "//z.net/", None, "allow"),
    ]


def test_pattern_rules_and_weights(spark):
    rules = [*URL_RULES, url_rules.pattern_rule("allow", "/ads/1$", ["ads"], weight=5)]
    got = judged(spark, ["http://a.b/ads/1", "http://a.b/ads/12", "http://www.casino.example/", "http://a.b/wp-login.php", "http://a.b/bads/1", "http://example.net/en/ads/1"], rules)
    assert [v[3] for v in got.values()] == ["allow", "block", "block", "block", "allow", "allow"]


def test_index_takes_the_rarest_token(spark):
    urls = spark.createDataFrame([("u", ["a", "b"]), ("v", ["a"])], "url string, tokens array<string>")
    rules = url_rules.rule_table(spark, [url_rules.pattern_rule("block", "x", ["a", "b"]), url_rules.pattern_rule("block", "y", ["a", "zz"])])
    assert {r["rule"]: r["token"] for r in url_rules.rule_index(rules, urls).collect()} == {"x": "b", "y": "zz"}


def test_columns_named_like_helpers_stay(spark):
    names = ["url", "__host", "__path", "__URL", "__best", "tokens", "host"]
    pages = spark.createDataFrame([("http://a.net/x", *"abcdef")], ", ".join(f"{n} string" for n in names))
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES))
    assert got.columns == [*names[:-1], "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == ("http://a.net/x", *"abcde", "a.net", "/x", "net/", "block")


def test_url_edges(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["http://a.net/"], []) == {0: ("a.net", "/", None, "allow")}
    assert len(judged(spark, ["http://a.net/" + "x" * 100_000])) == 1
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES)).count() == 2
    with pytest.raises(ValueError):
        url_rules.pattern_rule("block", "x", [])


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op8_url_filter"])
def test_no_python_in_native_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TURNS = "conv_id long, turn long, role string, text string, perspective string, start long"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "p", 7) for r in rows], TURNS)


def test_views_of_three_speakers(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé😀"), (1, 3, "ann", None), (1, 4, None, "?"), (2, 0, "system", "alone")]
    messages = chat_views.rotate(talk(spark, rows))
    views = {r["perspective"]: r for r in chat_views.shards(messages).collect()}
    assert set(views) == {"ann", "bob", "unknown"}
    bob = "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nhé😀<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n<|im_start|>user name=unknown\n?<|im_end|>\n"
    assert views["bob"]["text"] == bob
    assert [bob[m["start"] : m["end"]] for m in views["bob"]["masks"]] == ["hé😀"]
    assert [views["ann"]["text"][m["start"] : m["end"]] for m in views["ann"]["masks"]] == ["hi", ""]
    for m in messages.collect():
        text = views[m["perspective"]]["text"]
        assert text[m["start"] : m["start"] + len(m["rendered"])] == m["rendered"]
        assert text[m["text_start"] : m["text_end"]] == (dict(((r[0], r[1]), r[3]) for r in rows)[m["conv_id"], m["turn"]] or "")


def test_chat_edges(spark):
    assert chat_views.rotate(talk(spark, [])).count() == 0
    rows = [(None, 1, "a", "x"), (None, None, "a", "y"), (1, 1, "a", "same"), (1, 1, "a", "same"), (1, 1, " ", "z" * 70_000)]
    got = chat_views.rotate(talk(spark, rows)).collect()
    assert [r["turn"] for r in sorted((r for r in got if r["conv_id"] is None), key=lambda r: r["position"])] == [None, 1]
    own = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "a"), key=lambda r: r["position"])
    assert [r["position"] for r in own] == [0, 1, 2] and own[1]["start"] == len(own[0]["rendered"])


def test_a_long_dialogue_in_shards(spark):
    rows = [(1, k, "ab"[k % 2], f"turn {k}") for k in range(500)]
    messages = chat_views.rotate(talk(spark, rows))
    whole = {r["perspective"]: r["text"] for r in chat_views.shards(messages).collect()}
    parts = sorted(chat_views.shards(messages, 1000).where("perspective = 'a'").collect(), key=lambda r: r["shard"])
    assert "".join(p["text"] for p in parts) == whole["a"] and len(parts) > 10
    assert all(p["text"][m["start"] : m["end"]].startswith("turn ") for p in parts for m in p["masks"])
