import hashlib
import random

import pytest

from scholia.llm import warc

FAKE = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    r = random.Random(1)
    bits = lambda: r.choice(["é" * r.randint(1, 40), "x" * r.randint(0, 900), warc.MAGIC, FAKE, "WARC/1.0", "\r\n", "\r\n\r\n", "\n"])
    rows = [(i, "http://a/\n" if i % 7 == 0 else None if i % 11 == 0 else "http://b", None if i % 13 == 0 else "".join(bits() for _ in range(r.randint(0, 6)))) for i in range(80)]
    rows += [(i, "u", rows[5][2] + warc.MAGIC + "z" * 1000) for i in range(80, 90)]
    return rows + [(None, "u", "q" * 1200), (None, None, None), (500, "u", "q" * 1200), (500, "u", "q" * 1200), (400, "u", "q" * 1200)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(first.get(h or "", -1), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and (h or "") in first and i != first[h or ""]
        yield (i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)


@pytest.mark.parametrize(("broadcast", "chain", "split"), [(100_000, 64 << 20, "128m"), (0, 1500, "3000")])
def test_round_trip(spark, tmp_path, broadcast, chain, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        df = spark.createDataFrame([(*r, 1) for r in pages()], "page_id long, url string, html string, file int").repartition(3)
        warc.write(df, str(tmp_path / "w"), broadcast)
        got = warc.read(spark, str(tmp_path / "w"), chain, broadcast).drop("file", "start").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(pages())))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_pages(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
