"""Facts of a text's words and characters by scans, without an array of either."""

import re

from tabulon.operators import text as X

TEXTS = ["", "...", "Übergröße ÷ naïve 3d x7 rhythm, beautiful! A", "ñandú çà-et-là ABC123def idea éé aeb", "aaa bcd bab babab bababab zyzzyva x", "tab\tline   \x0b end 😀😀", None]


def test_words_by_scans_equal_words_by_lists(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows.select("doc_id", *[c.alias(n) for n, c in X._word_facts(X.F.lower("text")).items()]).collect()}
    for i, t in enumerate(TEXTS[:-1]):
        words = re.findall("[a-zà-öø-ÿ0-9]+", t.lower())
        groups = [max(1, len(re.findall("[aeiouyà-æè-ïò-öù-ý]+", w))) for w in words]
        assert tuple(got[i])[1:] == (len(words), sum(map(len, words)), sum(groups), sum(g >= 3 for g in groups))
    plan = X.text_quality(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?s)." not in plan and "aggregate(" not in plan
    assert {r["doc_id"]: r["issues"].split(",")[0] for r in X.quality_issues(rows).collect()}[0] == "too_short"
