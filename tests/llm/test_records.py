"""WARC derivatives and licence scans: SQL, fixed cases and oddities."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest

from quizlake.llm import licenses, warc
from quizlake.llm.queries import QUERIES
from tests.oracle_check import compare, connection


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_queries_match_their_sql(spark, folder, name):
    good, note = compare(spark, connection(folder), name, QUERIES[name].plan, QUERIES[name].sql, folder)
    assert good, note


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file
    except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0"""


def test_rules_over_sentences(spark):
    cases = [
        (1, APACHE, ["Apache-2.0"]),
        (2, "Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        (3, "Some text. Released under the MIT License. More.", ["MIT"]),
        (4, "x\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", ["CC-BY-NC-4.0", "GPL-3.0"]),
        (5, "The license of a driver. A permission slip.", []),
        (6, "Released under the MIT License. " * 3, ["MIT"]),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {i: w for i, _, w in cases}
    assert got[6]["sentence_ids"] == ["mit-short"] * 3 and len(got[1]["sentence_ids"]) == 4


def test_licences_of_odd_rows(odd, nothing):
    got = licenses.scan(odd).collect()
    assert len(got) == odd.count() and all(r["licenses"] == [] and r["sentence_ids"] == [] for r in got)
    assert licenses.scan(nothing).collect() == []


PAGES = [
    (1, "http://a/", '<html lang="EN"><head><title> A  b </title><style>p{}</style></head><body><p>One &amp; two</p><script>var x="</p>";</script><a href="/x">go</a><br>end</body></html>'),
    (2, None, None),
    (3, "", ""),
    (None, "http://a/", "<p>x"),
    (3, "", ""),
]


def test_derivatives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as block", "2 as kind", "'z' as r")
    made = warc.derivatives(warc.responses_of_pages(pages), keep=["page_id"]).collect()
    assert len(made) == 2 * len(PAGES)
    first = {r["record_type"]: r for r in made if r["page_id"] == 1}
    assert first["conversion"]["block"] == "A b\nOne & two\ngo\nend"
    assert first["metadata"]["block"] == "title: A b\r\nlanguage: en\r\noutlink: /x\r\n"
    for r in made:
        raw = r["block"].encode()
        assert r["content_length"] == len(raw) and r["block_digest"] == "sha256:" + hashlib.sha256(raw).hexdigest()
        assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["headers"] and r["refers_to"] != r["record_id"]
        assert ("WARC-Target-URI" in r["headers"]) == (r["target_uri"] is not None)
    ids = {(r["page_id"], r["record_type"]): r["record_id"] for r in made}
    assert len(set(ids.values())) == len(ids)
    payload = PAGES[0][2].encode()
    assert first["conversion"]["source_digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()


ODD = """<html
 LANG='De-at'><title>x</title><!-- <a href="/no">n</a> --><a href='/one'>1</a><A class=q HREF=/two>2</A><a data-href="/no2" href = "/three?a=1&amp;b=2">3</a>
<a name=x>4</a><script>document.write('<a href="/no3">')</script><p>It&#8217;s &#x1F642; &mdash; &amp;lt; &nope; &#0;&#xD800;&#9999999; a&b;c &copy</p>"""


def test_odd_markup(spark):
    made = warc.derivatives(warc.responses_of_pages(spark.createDataFrame([(1, "u", ODD)], "page_id long, url string, html string"))).collect()
    block = {r["record_type"]: r["block"] for r in made}
    assert block["metadata"].split("\r\n") == ["title: x", "language: de-at", "outlink: /one", "outlink: /two", "outlink: /three?a=1&amp;b=2", ""]
    assert block["conversion"].split("\n")[-1] == "4 It’s 🙂 — &lt; &nope; \ufffd\ufffd\ufffd a&b;c &copy"


def test_odd_markup_by_sql(spark):
    rng = random.Random(3)
    parts = ["<a href=", "'x'", '"y z"', "/q>", "<!--", "-->", "<p>", "</p>", "&#8217;", "&#x2014;", "&amp;", "&#55296;", "&eacute;", "<html lang=", "é", " ", "\n", "<title>", "</title>", "<br/>", ">", "<script>", "</script>"]
    rows = [(i, "u", "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(300)] + [(900, "u", ODD), (901, None, None)]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841 - read by DuckDB
    want = duckdb.sql(warc.oracle())
    made = warc.derivatives(warc.responses_of_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), keep=["page_id"])
    assert sorted(map(str, (tuple(r) for r in made.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_every_header_of_the_source_is_kept(spark):
    head = "HTTP/1.1 200 OK\r\nServer: a: b\r\nSet-Cookie: x\r\nSet-Cookie: y\r\nContent-Type: text/html\r\n\r\n"
    one = spark.createDataFrame([("<urn:1>", "http://u/", "2024-01-01T00:00:00Z", head, "<p>t")], "record_id string, target_uri string, date string, http_headers string, payload string")
    for r in warc.derivatives(one).collect():
        assert [line for line in r["headers"].split("\r\n") if line.startswith("X-Source-") and "Digest" not in line] == [
            "X-Source-Server: a: b", "X-Source-Set-Cookie: x", "X-Source-Set-Cookie: y", "X-Source-Content-Type: text/html"
        ]
        assert r["source_type"] == "text/html" and "WARC-Date: 2024-01-01T00:00:00Z\r\n" in r["headers"]


def test_whole_records(spark):
    pages = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses_of_pages(pages))
    for r in made.select("*", warc.record_bytes(made["headers"], made["block"]).alias("raw")).collect():
        head, _, body = bytes(r["raw"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body == r["block"].encode() + b"\r\n\r\n"


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses_of_pages(none)).collect() == []
