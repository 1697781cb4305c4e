"""URL filters and WARC derivatives."""

import base64
import hashlib

import pytest

from lanewise.llm import urls as U
from lanewise.llm import warc as W

PAGES = "page_id bigint, url string, html string"
LABELS = "doc_id bigint, quality int, toxic int"


def judged(spark, pages, labels=(), **mining):
    p = spark.createDataFrame([(i, u, "") for i, u in pages], PAGES)
    return {r.id: r for r in U.filter_urls(p, spark.createDataFrame(list(labels), LABELS), **mining).collect()}


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.example.com/en/81?x=1#y", "a.example.com", "/en/81", "com/en/", "block"),
        ("https://EXAMPLE.com/en/7/x", "example.com", "/en/7/x", "example.com/en/7", "allow"),
        ("https://badexample.com/en/7", "badexample.com", "/en/7", "com/en/", "block"),
        ("ftp://x.net/de/1", "x.net", "/de/1", "net/de/", "block"),
        ("http://www.example.net/de/8", "www.example.net", "/de/8", "example.net/de/8", "block"),
        ("http://x.org/EN/es/", "x.org", "/EN/es/", None, "allow"),
        ("http://x.org?/es/", "x.org", "", None, "allow"),
        ("x.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a://b://c/en/", "b:", "//c/en/", None, "allow"),
    ],
)
def test_written_rules(spark, url, host, path, rule, verdict):
    r = judged(spark, [(1, url)])[1]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_mined_rules_block_combinations(spark):
    pages = [(i, f"http://shop{i % 3}.test/{'win' if i % 2 else 'news'}/page{i}") for i in range(60)]
    labels = [(i, 0 if i % 3 == 1 and i % 2 else 1, 0) for i in range(60)]
    got = judged(spark, pages + [(100, "http://shop1.test/win/new"), (101, "http://shop1.test/news/new"), (102, "http://shop2.test/win/new")], labels, support=0.01)
    assert [got[i].verdict for i in (100, 101, 102)] == ["block", "allow", "allow"]
    assert got[1].mined and not got[0].mined


def test_rules_of_three_tokens(spark):
    # bad only where a, b and c stand together; every pair of them is mostly good
    parts = ["a/b/c", "a/b", "a/c", "b/c", "a", "b", "c"]
    pages = [(i, f"http://x.test/{parts[i % 7]}/") for i in range(140)]
    labels = [(i, 0 if i % 7 == 0 else 1, 0) for i in range(140)]
    got = judged(spark, pages + [(200, "http://y.test/c/b/a/new"), (201, "http://y.test/a/b/new")], labels, support=0.01)
    assert [got[i].verdict for i in (200, 201)] == ["block", "allow"]


def test_rules_have_no_smaller_rule_inside(spark):
    rows = [(["a", "b", "c", "d"], True)] * 20 + [(["a", "b", "d"], False)] * 20 + [(["a", "c", "d"], False)] * 20 + [(["b", "c"], False)] * 20
    rules = U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert sorted(r.antecedent for r in rules) == [["a", "b", "c"], ["b", "c", "d"]]


def test_a_family_that_shares_thirty_tokens(spark):
    """Tokens of the same rows are mined as one; rules by brute force on what is small."""
    from itertools import combinations

    shared = [f"t{k:02d}" for k in range(30)]
    rows = [([*shared, "x", f"u{i}"], True) for i in range(6)] + [([*shared[:20], "y"], False)] * 3 + [([*shared[20:], "x"], False)] * 3 + [(["x", "y"], False)] * 20 + [(["lone", "x"], True)] * 9
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    import time

    start = time.time()
    got = sorted((sorted(map(sorted, r.parts)), sorted(r.keys)) for r in U.mine_compact(df).collect())
    assert time.time() - start < 60
    first, second = shared[:20], shared[20:]
    # by hand: the first twenty with the last ten, the first with x; the last ten need more
    assert (sorted([first, ["x"]]), first) in got and ([["lone"]], ["lone"]) in got and (sorted([first, second]), first) in got or (sorted([first, second]), second) in got
    few = [([t for t in ts if t not in shared[1:20] + shared[21:]], bad) for ts, bad in rows]
    want = set()
    tokens = sorted({t for ts, _ in few for t in ts})
    for n in range(1, 5):
        for c in map(set, combinations(tokens, n)):
            hit = [bad for ts, bad in few if c <= set(ts)]
            if sum(hit) >= 5 and sum(hit) / len(hit) >= 0.9 and not any(w < c for w in map(set, want)):
                want.add(tuple(sorted(c)))
    assert {tuple(r.antecedent) for r in U.mine_rules(spark.createDataFrame(few, "tokens array<string>, bad boolean")).collect()} == want
    spelt = {r.antecedent[0][:1] + r.antecedent[-1] for r in U.mine_rules(df).where("array_contains(antecedent, 'x')").collect()}
    assert spelt == {"tx"}


def test_rare_rules_are_pruned(spark):
    got = judged(spark, [(i, f"http://h{i}.test/a") for i in range(30)], [(1, 0, 1), (2, 0, 1)])
    assert {r.verdict for r in got.values()} == {"allow"}


def test_url_edge_cases(spark):
    p = spark.createDataFrame([(1, "http://a.test/", "x")] * 2 + [(None, "http://a.test/", None), (3, None, None)], PAGES)
    for c in ("host", "path", "mined", "tokens", "bad", "id", "rule"):
        p = p.selectExpr("*", f"'clash' AS {c}")
    labels = spark.createDataFrame([(1, None, None), (1, 0, 0), (None, 0, 1)], LABELS)
    assert U.filter_urls(p, labels).count() == 4
    assert U.filter_urls(p.where("false"), labels.where("false")).count() == 0


def test_url_plan_is_native(spark, data):
    from lanewise.llm.queries import op4_url_filter

    plan = op4_url_filter(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


PAGE = (
    '<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p><p>hidden";</script></head>'
    '<body><p>One<br>two &lt;three&gt;<!-- not <b>shown --> four<a href="/x?a=1&amp;b=2" title="a > b">link</a>'
    "<script>if (a < b) { }</script><div>next <b>bold</b> text</div>3 < 4<p>unclosed"
)


def test_extract():
    text, title, language, links = W.extract(PAGE)
    assert (title, language, links) == ("A & B", "de", ["/x?a=1&b=2"])
    assert text.split("\n") == ["One", "two <three> fourlink", "next bold text", "3 < 4", "unclosed"]


@pytest.mark.parametrize("page, text", [("", ""), ("<", "<"), ("a<!-- open", "a"), ("<script>x", ""), ("<p a='>b", "b"), ("<b>x</i></b>y", "xy"), ("&#x41;&bogus;", "A&bogus;")])
def test_extract_broken_pages(page, text):
    assert W.extract(page)[0] == text


def test_extract_is_linear():
    import time

    start = time.time()
    for bad in ("<!-- ", "<a ", "<a '", '<a "', "< ", "<title>", "</x", "<script>"):
        W.extract(bad * 40_000)
    assert time.time() - start < 30


def test_derivatives_link_and_digest(spark):
    pages = spark.createDataFrame([(1, "http://a.test/x", PAGE), (2, None, None), (2, None, None)], PAGES).selectExpr("*", "'clash' AS key", "'clash' AS type", "'clash' AS payload")
    got = W.derivatives(W.responses_from_pages(pages)).collect()
    assert len(got) == 6
    source = "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    meta, conv = sorted((r for r in got if r.key == 1), key=lambda r: r.type, reverse=True)
    assert (meta.type, conv.type) == ("metadata", "conversion")
    assert meta.refers_to == conv.refers_to and meta.refers_to not in (meta.record_id, conv.record_id)
    assert meta.source_digest == conv.source_digest == source and meta.target_uri == "http://a.test/x"
    block = bytes(meta.block).decode()
    assert f"conversion-id: {conv.record_id}\r\n" in block and "source-header: HTTP/1.1 200 OK\r\n" in block and "title: A & B\r\n" in block
    assert bytes(conv.block).decode() == W.extract(PAGE)[0]
    for r in got:
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.block)).digest()).decode()


def test_records_round_trip(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    records = W.derivatives(W.responses_from_pages(pages))
    whole = {(r.key, r.type): r for r in records.collect()}
    for compress in (True, False):
        parts = W.packed(records, compress).collect()
        assert len(parts) == len(whole)
        for p in parts:
            ((head, block),) = W.parse(bytes(p.warc))
            r = whole[p.key, p.type]
            assert block == bytes(r.block) and head["WARC-Refers-To"] == r.refers_to and head["WARC-Target-URI"] == r.target_uri
    both = b"".join(W.serialise(r.asDict(), False) for r in list(whole.values())[:5])
    assert len(list(W.parse(both))) == 5


def test_warc_query(spark, data):
    from lanewise.llm.queries import op7_warc_derivatives

    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = op7_warc_derivatives(spark, data).collect()
    assert len(got) == 2 * len(pages) and len({r.record_id for r in got}) == len(got)
    text = {r.page_id: r for r in got if r.type == "conversion"}
    for p in pages:
        t = W.extract(p.html)[0].encode()
        assert text[p.page_id].content_length == len(t) and text[p.page_id].block_sha256 == hashlib.sha256(t).hexdigest()
    assert W.derivatives(W.responses_from_pages(spark.createDataFrame([], PAGES))).count() == 0


def plain(page):
    """Text, title, language and links of a well-formed page by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.links, self.title, self.language, self.inside = [], [], None, None, []

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.links += [v for k, v in attrs if k == "href" and v]
            if tag == "html":
                self.language = dict(attrs).get("lang")
            if tag == "body":
                self.inside = []
            if tag in W.HIDDEN:
                self.inside.append(tag)
            if tag in W.BREAKS:
                self.out.append("\n")

        def handle_endtag(self, tag):
            if tag in self.inside:
                self.inside.remove(tag)
            if tag in W.BREAKS:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.inside:
                self.out.append(data.replace("\n", " "))
            elif self.inside[-1] == "title" and self.title is None:
                self.title = " ".join(data.split())

    r = Reader()
    r.feed(page or "")
    r.close()
    lines = (" ".join(x.replace("\xa0", " ").split()) for x in "".join(r.out).split("\n"))
    return "\n".join(x for x in lines if x), r.title, r.language, r.links


def test_warc_query_against_another_parser(spark, data):
    """Every record rebuilt without the operator: ids, digests, headers, text."""
    from lanewise.llm.queries import op7_warc_derivatives

    got = {(r.page_id, r.type): r for r in op7_warc_derivatives(spark, data).collect()}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for p in spark.read.parquet(f"{data}/pages.parquet").collect():
        payload = (p.html or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
        text, title, language, links = plain(p.html)
        m, c = got[p.page_id, "metadata"], got[p.page_id, "conversion"]
        about = [f"conversion-id: {c.record_id}", f"source-payload-digest: {sha(payload)}", f"source-block-digest: {sha(head.encode() + b'\r\n\r\n' + payload)}"]
        about += [f"source-header: {x}" for x in head.split("\r\n")]
        about += [f"title: {title}"] if title else []
        about += [f"language: {language}"] if language else []
        about += [f"outlink: {' '.join(x.split())}" for x in links]
        for r, block in ((m, "".join(x + "\r\n" for x in about).encode()), (c, text.encode())):
            assert (r.block_digest, r.content_length, r.block_sha256) == (sha(block), len(block), hashlib.sha256(block).hexdigest())
            assert (r.target_uri, r.source_digest, r.refers_to) == (p.url or "", sha(payload), m.refers_to)
        assert len({m.record_id, c.record_id, m.refers_to}) == 3


def test_record_ids_follow_the_content(spark):
    rows = [(1, "http://a.test/", "<p>one"), (1, "http://a.test/", "<p>two"), (1, "http://a.test/", None), (1, "http://a.test/", ""), (None, "http://a.test/", "<p>one"), (1, "http://a.test/", "<p>one")]
    got = W.derivatives(W.responses_from_pages(spark.createDataFrame(rows, PAGES))).collect()
    assert len(got) == 12 and len({r.record_id for r in got}) == 10 and len({r.refers_to for r in got}) == 5


def record_of(n, block=b"HTTP/1.1 200 OK\r\n\r\nbody", kind="response"):
    return {"type": kind, "record_id": f"<urn:uuid:{n}>", "date": "2024-05-01T00:00:00Z", "target_uri": "http://a.test/", "refers_to": None, "block_digest": "", "content_type": "application/http", "block": block}


@pytest.mark.parametrize("compress", [True, False])
def test_damaged_records_are_skipped_and_told(spark, compress):
    import gzip

    good = [W.serialise(record_of(n), compress) for n in range(4)]
    odd = b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Record-ID:<urn:uuid:7>\r\nWARC-Date: 2024-05-01T00:00:00Z\r\nX: a\r\n folded: line\r\nno colon\r\nContent-Length:2\r\n\r\nhi\r\n\r\n"
    no_length = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nhello\r\n\r\n"
    no_id = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: x\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    pack = gzip.compress if compress else bytes
    cut = good[3][: len(good[3]) - 30]
    data = good[0] + pack(no_length) + good[1] + pack(odd) + pack(no_id) + pack(b"rubbish\r\n\r\nmore") + good[2] + cut
    df = spark.createDataFrame([("f", bytearray(data)), ("whole", bytearray(b"".join(good))), ("none", None), ("junk", bytearray(b"\x1f\x8b\x08junk" if compress else b"junk"))], "path string, content binary")
    got = {(r.key.split("#")[0], r.record_id) for r in W.responses_from_warc(df).collect()}
    assert got == {("f", f"<urn:uuid:{n}>") for n in (0, 1, 7, 2)} | {("whole", f"<urn:uuid:{n}>") for n in range(4)}
    damage = sorted((r.path, r.reason) for r in W.damage_in_warc(df).collect())
    assert [p for p, _ in damage] == ["f"] * 4 + ["junk"]
    assert {"a record without its length", "a response without WARC-Record-ID", "the file is cut off"} <= {r for _, r in damage}
    heads = {h["WARC-Record-ID"]: h for h, _, wrong in W.read_records(data) if not wrong and "WARC-Record-ID" in h}
    assert heads["<urn:uuid:7>"]["X"] == "a folded: line"


def test_members_are_inflated_one_by_one():
    """A damaged member costs itself, one member may hold many records, and records
    may be larger than the pieces that are read."""
    import gzip

    big = record_of(1, b"x" * 3_000_000)
    broken = bytearray(W.serialise(record_of(2, bytes(range(256)) * 40)))
    broken[40:60] = b"\xff" * 20
    data = W.serialise(big) + bytes(broken) + gzip.compress(b"".join(W.serialise(record_of(n), False) for n in (3, 4)))
    found = [(h.get("WARC-Record-ID"), len(b), bool(wrong)) for h, b, wrong in W.read_records(data)]
    assert [f for f in found if not f[2]] == [("<urn:uuid:1>", 3_000_000, False)] + [(f"<urn:uuid:{n}>", 23, False) for n in (3, 4)] and any(f[2] for f in found)
    pieces = [len(p) for p in W.inflated(gzip.compress(bytes(50_000_000)))]
    assert sum(pieces) == 50_000_000 and max(pieces) <= 1 << 20
    with pytest.raises(ValueError):
        list(W.parse(b"nothing"))


def test_responses_of_a_crawl_keep_their_headers(spark):
    head = "HTTP/1.1 404 Not Found\r\nServer: x\r\nContent-Type: text/html"
    block = head.encode() + b"\r\n\r\n<p>gone"
    response = {"type": "response", "record_id": "<urn:uuid:1>", "date": "2024-05-01T00:00:00Z", "target_uri": "http://a.test/", "refers_to": None, "block_digest": "", "content_type": "application/http", "block": block}
    other = response | {"type": "request", "record_id": "<urn:uuid:2>"}
    files = [("a.warc.gz", bytearray(W.serialise(other) + W.serialise(response))), ("b.warc", bytearray(W.serialise(response | {"record_id": "<urn:uuid:3>"}, False))), ("c.warc", None)]
    got = W.responses_from_warc(spark.createDataFrame(files, "path string, content binary"))
    assert sorted((r.key, r.record_id, r.date, r.headers, bytes(r.payload)) for r in got.collect()) == [
        ("a.warc.gz#1", "<urn:uuid:1>", "2024-05-01T00:00:00Z", head, b"<p>gone"), ("b.warc#0", "<urn:uuid:3>", "2024-05-01T00:00:00Z", head, b"<p>gone"),
    ]
    metadata = [r for r in W.derivatives(got).collect() if r.type == "metadata"]
    assert all("source-header: Server: x\r\n" in bytes(r.block).decode() and r.date == "2024-05-01T00:00:00Z" for r in metadata) and len(metadata) == 2
