"""Requests to a service: retries, resumption, and a server on this machine."""

import http.server
import json
import threading
import urllib.parse

import pytest

from veriscreen import cli
from veriscreen.sources import markup, service


def article(k, title="T"):
    return f"<PubmedArticle><MedlineCitation><PMID>{k}</PMID><Article><ArticleTitle>{title}{k}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"


def answer(ids):
    return f"<PubmedArticleSet>{''.join(map(article, ids))}</PubmedArticleSet>"


def failing(folder, times):
    """A client that fails so many times for each request before it answers."""

    def client(ids):
        seen = folder / f"{ids[0]}"
        n = int(seen.read_text()) if seen.exists() else 0
        seen.write_text(str(n + 1))
        if n < times:
            raise OSError("no answer")
        return answer(ids)

    return client


def batches(spark, n=10, size=2):
    return markup.request_batches(spark.createDataFrame([(str(k),) for k in range(1, n + 1)], "pmid string"), size)


def test_requests_that_fail_are_sent_again(spark, tmp_path):
    got = service.fetched(batches(spark), failing(tmp_path, 2), pause=0.01, retries=2, lanes=2).collect()
    assert sorted((r.batch, r.attempts) for r in got) == [(k, 3) for k in range(5)]
    assert sorted(r.pmid for r in markup.parse_articles(spark.createDataFrame(got), 1).collect()) == sorted(map(str, range(1, 11)))


def test_an_interrupted_run_goes_on(spark, tmp_path):
    (tmp_path / "calls").mkdir()

    def broken(ids):
        if "7" in ids:
            raise OSError("gone")
        return answer(ids)

    tables = str(tmp_path / "requests"), str(tmp_path / "responses")
    with pytest.raises(Exception, match="request 3 failed 2 times"):
        service.collected(*tables, batches(spark), broken, pause=0.0, retries=1, wave=2)
    assert sorted(r.batch for r in spark.read.parquet(tables[1]).collect()) == [0, 1]
    done = service.collected(*tables, batches(spark), failing(tmp_path / "calls", 0), pause=0.0, wave=2)
    assert sorted(r.batch for r in done.collect()) == list(range(5))
    assert sorted(p.name for p in (tmp_path / "calls").iterdir()) == ["5", "7", "9"]  # the others were not asked again
    with pytest.raises(ValueError, match="asked before"):
        service.collected(*tables, batches(spark, 12), broken)


class Handler(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
        assert form["email"] == ["a@b.c"] and form["retmode"] == ["xml"]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(answer(form["id"][0].split(",")).encode())

    def log_message(self, *args):
        pass


def test_fetch_from_a_server(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "ids.txt").write_text("".join(f"{k}\n" for k in (30, 4, 7)))
    try:
        cli.main(["fetch", "--pmids", str(tmp_path / "ids.txt"), "--label", "0", "--output-dir", str(tmp_path / "out"), "--batch-size", "2", "--email", "a@b.c", "--endpoint", f"http://127.0.0.1:{server.server_port}/", "--pause", "0"], spark)
    finally:
        server.shutdown()
    manifest = json.loads((tmp_path / "out/retrieval_manifest.json").read_text())
    assert manifest["requested"] == manifest["retrieved"] == 3 and manifest["missing_abstracts"] == ["4", "7", "30"] and [x["batch"] for x in manifest["raw_xml"]] == [0, 1]
    assert spark.read.json(str(tmp_path / "out/articles")).count() == 3


def test_documents_as_a_parser_reads_them(spark):
    one = "<PubmedArticleSet><PubmedArticle><MedlineCitation><!-- <PMID>9</PMID> --><PMID>1</PMID><Article><ArticleTitle>A <![CDATA[<b> & c]]> d&#233;</ArticleTitle><Abstract><AbstractText>x<!-- no -->y <i>z</i></AbstractText><AbstractText/><AbstractText> w </AbstractText></Abstract></Article></MedlineCitation></PubmedArticle><!-- <PubmedArticle/> --></PubmedArticleSet>"
    got = markup.parse_articles(spark.createDataFrame([(one,), (None,), ("<PubmedArticleSet/>",)], "xml string"), 1).collect()
    assert [tuple(r) for r in got] == [("1", "A <b> & c dé", "xy z\n\nw", 1)]
    for bad, message in (("<PubmedArticleSet><e><ERROR>too many</ERROR></e></PubmedArticleSet>", "too many"), ("<PubmedArticleSet><PubmedArticle>", "no element|not well|mismatched|unclosed"), ("<a><PubmedArticle/></a>", "without a citation")):
        with pytest.raises(Exception, match=message):
            markup.parse_articles(spark.createDataFrame([(bad,)], "xml string"), 1).collect()
