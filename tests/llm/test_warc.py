"""Archives and their index: exact round trips and lookups."""

import gzip

import pytest

from netlantern.llm import warc

PAGES = [
    (1, "http://a.example.com/x?q=1#top", "<p>one</p>"),
    (2, "https://b.example.com/", "<p>one</p>"),
    (3, "HTTP://user@A.Example.com:8080/x", "two \r\n\r\n WARC/1.1\r\n"),
    (3, "HTTP://user@A.Example.com:8080/x", "two \r\n\r\n WARC/1.1\r\n"),
    (4, None, ""),
    (5, "", None),
    (None, "http://a.example.com/x?q=1", "<p>one</p>"),
    (None, None, "only without an id"),
    (6, "http://b.example.com/\r\nX: 50%", "é\U0001f600" * 5000),
    (2**62 + 1, "http://a.example.com/x?q=1", "big"),
    (2**62 + 3, "no host", "big"),
]


@pytest.fixture(scope="module")
def pages(llm):
    rows = [(*p, "x", b"y") for p in PAGES]
    return llm.createDataFrame(rows, "page_id long, url string, html string, key string, digest binary")


def expected():
    payloads = {}
    for i, _, html in PAGES:
        payloads.setdefault(html or "", []).append(i)
    for i, url, html in PAGES:
        data = (html or "").encode()
        ids = [x for x in payloads[html or ""] if x is not None]
        keeper = max(ids, default=None)
        revisit = keeper is not None and keeper != i
        yield (i, len(data), warc.digest_of(data), "revisit" if revisit else "response", keeper if revisit else None)


def test_round_trip(llm, pages):
    got = [tuple(r) for r in warc.round_trip(llm, pages).collect()]
    assert sorted(got, key=repr) == sorted(expected(), key=repr)
    assert warc.round_trip(llm, pages.limit(0)).count() == 0


@pytest.mark.parametrize("part, lines", [(50_000, 1000), (3, 2)])
def test_lookups(llm, pages, monkeypatch, part, lines):
    monkeypatch.setattr(warc.write_index, "__defaults__", (part, lines))
    made = warc.archive(llm, pages)
    urls = llm.createDataFrame(
        [("http://A.example.com/x?q=1",), ("ftp://b.example.com/",), (None,), ("http://none/",)], "url string"
    )
    got = sorted((r.key, repr(r.page_id)) for r in made.lookup(urls).collect())
    assert got == [
        ("", "4"),
        ("", "5"),
        ("", "None"),
        ("com,example,a)/x?q=1", "1"),
        ("com,example,a)/x?q=1", str(2**62 + 1)),
        ("com,example,a)/x?q=1", "None"),
        ("com,example,b)/", "2"),
    ]
    wanted = made.captures.filter("page_id = 3").select("key", "page_id").distinct()
    found = made.read(wanted).collect()
    assert [r.payload.decode() for r in found] == [PAGES[2][2]] * 2 and found[0].url == PAGES[2][1]


def test_archives_are_plain_warc(llm, pages):
    made = warc.archive(llm, pages)
    files, path = warc.open_folder(made.records)
    total = 0
    for name in {r.file for r in made.captures.collect()}:
        data = gzip.decompress(files.open_input_file(f"{path}/{name}").read())
        total += data.count(b"WARC/1.1\r\nWARC-Type: ")
    assert total == len(PAGES)


def test_damaged_records_are_errors():
    import zlib

    good = warc.make_record(1, "http://x/", b"abc", warc.digest_of(b"abc"), None)
    packed = lambda data: gzip.compress(data)
    assert warc.read_record(packed(good)).payload == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-1], b"x" + good):
        with pytest.raises((ValueError, zlib.error)):
            warc.read_record(packed(bad))


def test_small_payloads_stay_responses(llm, pages):
    got = warc.archive(llm, pages, least=8)
    wanted = got.captures.select("key", "page_id").distinct()
    kinds = {r.page_id: r.record_type for r in got.read(wanted).collect()}
    assert kinds[1] == "revisit" and kinds[4] == kinds[5] == "response"
    assert kinds[2**62 + 1] == "response"


@pytest.mark.parametrize("at_once, share", [(1000, 4096), (1, 4096), (1000, 0)])
def test_revisits_are_followed_to_their_payload(llm, pages, monkeypatch, at_once, share):
    """Every capture comes back with its payload, whoever's record holds it."""
    monkeypatch.setattr(warc, "AT_ONCE", at_once)
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    made = warc.archive(llm, pages)
    found = made.read(made.captures.select("key", "page_id").distinct())
    assert any(r.payload is None and r.refers_to_url for r in found.collect())
    got = made.follow(found).collect()
    data = sorted((repr(r.page_id), repr(r.url), bytes(r.payload).decode()) for r in got)
    assert data == sorted((repr(i), repr(u), html or "") for i, u, html in PAGES)
    assert all(warc.digest_of(bytes(r.payload)) == r.payload_digest for r in got)


def test_a_revisit_without_its_response_is_an_error(llm, pages):
    made = warc.archive(llm, pages)
    urls = llm.createDataFrame([(PAGES[0][1],)], "url string")
    found = made.lookup(urls).withColumn("payload_bytes", warc.F.col("payload_bytes") + 1)
    with pytest.raises(Exception, match="payload"):
        made.follow(found).collect()
