"""The rules of ``op5_url_filter`` are those of its contract, word for word."""

from tabulon.llm import urls

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_url_rules_are_the_contracts(spark):
    words = {host_path: word for word, host_path in (rule.split(" ") for rule in CONTRACT.split(", "))}
    assert {host + path: word for host, path, word in urls.RULES} == words
    rows = [(i, f"http://www.{rule}1") for i, rule in enumerate(words)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {i: item for i, item in enumerate(words.items())}
