import random
import re
from collections import Counter

import pytest

from scholia.llm import quality as Q
from scholia.llm import urlfilter as U

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    w = WORD.findall(t or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), failed)


def test_counts_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["a", "b ", " ", "c\n", "é#", "\n\n", "\x0b", "d e f g h ", "<|>"]) for _ in range(r.randint(0, 80)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "one two three four five " * 3000), (103, "x " * 12), (None, "a b"), (None, "a b")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_words int, kept int")
    got = [tuple(x) for x in Q.measure(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(got, key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)
    kept = Q.keep(d)
    assert kept.columns == d.columns and kept.where("kept <> 2 OR n_words <> 1").count() == 0
    assert kept.count() == Q.measure(d).where("kept").count()
    assert Q.keep(d.limit(0)).count() == 0


def test_verdicts(spark):
    good = "The cat and the dog went to a house in the town, and it was good for them to be there with us. " + " ".join(f"word{i} the" for i in range(40))
    bad = [" ".join(f"w{i}***" for i in range(60)), " ".join(f"LOUD{i}!!" for i in range(60)), "one line of words here\n" * 2, " ".join(f"x{i}" for i in range(80))]
    d = spark.createDataFrame(list(enumerate([good, *bad])), "doc_id long, text string")
    assert {r.doc_id for r in Q.keep(d).collect()} == {0}


URLS = ["http://a.COM/en/1", "https://example.com/en/7?x", "http://x.example.com/en/71#y", "http://xexample.com/en/7", "http://example.net/de/8", "http://b.example.net/de/80", "http://net/de/1", "http://org", "nothing", None, "://com/en/", "http://com?/en/", "http://.org/es/", "http://a.com:80/en/", "http://x://y.com/en/", "http://m.casino-win.example.org/fr/1", "http://example.net\n/de/8"]

OWN = [("block", "casino-win.example.org", "")]  # a list that the caller names


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    found = [(v, h, p) for v, h, p in U.CONTRACT_RULES if fits(h, p)]
    if found:
        v, h, p = max(found, key=lambda x: (len(x[1] + x[2]), len(x[1]), x[0] == "block"))
        return host, path, h + p, v
    return host, path, None, "block" if any(fits(h, "") for _, h, _ in OWN) else "allow"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_urls(spark, broadcast):
    rows = [(i, u, "r", "h") for i, u in enumerate(URLS * 3)] + [(None, URLS[0], "r", "h")]
    d = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    got = U.judge(d, U.rules_table(spark, U.CONTRACT_RULES, OWN), broadcast_rules=broadcast).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *expected(u))) for i, u, _, _ in rows)


def test_very_long_urls_and_clashing_names(spark):
    url = "http://" + "a." * 5000 + "example.com/en/7" + "x" * 200_000
    d = spark.createDataFrame([(1, url, 0, "s", 0)], "page_id long, url string, row_ int, short string, path int")
    got = U.judge(d, U.rules_table(spark, U.CONTRACT_RULES)).collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.com/en/7", "allow")]


def test_no_rules_and_no_urls(spark):
    none = spark.createDataFrame([], U.RULE_SCHEMA)
    d = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    assert [r.verdict for r in U.judge(d, none).collect()] == ["allow"]
    assert U.judge(d.limit(0), U.rules_table(spark, U.CONTRACT_RULES)).count() == 0
