"""Paged services against a server in this process; structure of XML and pages; names that share words."""

import json
import random
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from refsift.sources import documents, markup
from refsift.sources.services import PagedService, results

ROWS = {"2020": 23, "2021": 7, "": 11}


@pytest.fixture
def service(spark):
    """Rows of a slice in pages by number, offset or cursor; every third call of /flaky fails once."""
    calls, times, lock = Counter(), [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            with lock:
                calls[self.path] += 1
                times.append(time.monotonic())
                n = calls[self.path]
            size, total = int(q.get("n", 5)), ROWS[q.get("s", "")]
            code = 200
            if u.path == "/flaky" and n == 1 and int(q["p"]) % 3 == 1:
                code = 429
            if u.path == "/broken" or (u.path == "/cut" and q["c"] == "c10"):
                code = 400 if u.path == "/broken" else 503
            start = (int(q["p"]) - 1) * size if "p" in q else int(q["o"]) if "o" in q else 0 if q.get("c", "*") == "*" else int(q["c"][1:])
            rows = [{"id": f"{q.get('s', '')}-{k}"} for k in range(start, min(total, start + size))]
            after = f"c{start + size}" if start + size < total else None
            body = json.dumps({"data": {"rows": rows}, "next": after}).encode() if code == 200 else b""
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedService)
    yield f"http://127.0.0.1:{server.server_port}", calls, times
    server.shutdown()


def load(spark, **options):
    return spark.read.format("paged_service").options(**{"items": "data.rows", "next": "next", "size": "5", "limit": "100"} | {k: str(v) for k, v in options.items()}).load()


def ids(pages, limit=None):
    return [(r["slice"], r["rank"], r["r"]["id"]) for r in results(pages, "data.rows", "id string", limit).orderBy("slice", "rank").collect()]


def expected(slices, limit=10**6):
    return [(s, k + 1, f"{s}-{k}") for s in slices for k in range(min(limit, ROWS[s]))]


@pytest.mark.parametrize(("style", "query"), [("page", "p={from}"), ("offset", "o={from}"), ("cursor", "c={from}")])
def test_all_rows_of_all_slices(spark, service, style, query):
    url, calls, _ = service
    pages = load(spark, url=f"{url}/rows?s={{slice}}&n={{size}}&{query}", style=style, slices="2020|2021", limit=25, lanes=3)
    got = pages.persist()
    assert ids(got) == expected(["2020", "2021"]) and ids(got, 9) == expected(["2020", "2021"], 9)
    assert set(calls.values()) == {1} and sum(calls.values()) == (7 if style == "cursor" else 10)
    assert pages.rdd.getNumPartitions() == (2 if style == "cursor" else 3)
    got.unpersist()


def test_calls_are_tried_again_and_paced(spark, service):
    url, calls, times = service
    rows = load(spark, url=f"{url}/flaky?p={{from}}&n={{size}}", style="page", limit=11, lanes=1, pause=0.05).collect()
    assert sum(json.loads(r["body"])["data"]["rows"] != [] for r in rows) == 3 and all(r["error"] is None for r in rows)
    assert sorted(calls.values()) == [1, 1, 2] and min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.045


def test_failures_are_told_and_passed_over_later(spark, service):
    url, calls, _ = service
    options = {"url": f"{url}/cut?s={{slice}}&c={{from}}", "style": "cursor", "slices": "2020", "attempts": 2}
    first = load(spark, **options).collect()
    assert [(r["place"], r["error"]) for r in first] == [("*", None), ("c5", None), ("c10", "HTTP 503")] and calls["/cut?s=2020&c=c10"] == 2
    held = [r for r in first if r["body"]]
    options["url"] = options["url"].replace("/cut", "/rows")
    rest = load(spark, **options, done="|".join(f"{r['slice']}:{r['place']}" for r in held)).collect()
    assert [r["place"] for r in rest] == ["c10", "c15", "c20"] and calls["/rows?s=2020&c=%2A"] == 0
    broken = load(spark, url=f"{url}/broken?p={{from}}", simple=f"{url}/rows?p={{from}}", style="page", limit=5).collect()
    assert [len(json.loads(r["body"])["data"]["rows"]) for r in broken] == [5] and calls["/broken?p=1"] == 1
    pages = load(spark, url=f"{url}/rows?p={{from}}", style="page", limit=15, done=":2|:1").collect()
    assert [r["place"] for r in pages] == ["3"]


def test_sections(spark):
    xml = """<article><front><p>no</p></front><body><p>none</p><sec><title>One <i>x</i></title><p>a <b>b</b> c</p><sec><title/><p> inner </p><list><p>no</p></list></sec><p>last</p></sec>
    <sec><title>Empty</title><sec><title>Deep</title><p>d &amp; e</p></sec></sec></body></article>"""
    rows = spark.createDataFrame([(xml,), ("<a><sec><p>x</p>",), (None,), ("<a/>",)], "x string").select(markup.xml_sections("x").alias("s"), markup.xml_flat("x").alias("f")).collect()
    assert [r["s"] for r in rows] == ["### One \n\na b c\n\nlast\n\ninner\n\n### Deep\n\nd & e", None, None, None] and all(r["f"] is None for r in rows)
    long_ = "<a>" + "<p>word </p>" * 200 + "</a>"
    assert spark.range(1).select(markup.xml_flat(F.lit(long_)).alias("f")).first()["f"] == " ".join(["word"] * 200)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div class='a'>x</div><article><p>A</p><article>B</article> C</article><article>D</article>E</body>", "A\nB\nC"),
        ("<body>x<div class='page-content'><div>A</div><div class='paper'>B</div></div>C<main>D</main></body>", "A\n\nB"),
        ("<body>x<main>A<nav>n</nav><script>s</script></main>C</body>", "A"),
        ("<head><title>t</title></head><body><header>h</header>A<p>B<footer>f</footer></body>", "A\nB"),
        ("<nav><article>no</article></nav><main>A<div>B</main></div>", "A\nB"),
    ],
)
def test_containers(page, text, monkeypatch):
    monkeypatch.setattr(markup, "LEAST_PAGE", 0)
    assert [x for x in markup.article_of(page).split("\n") if x] == [x for x in text.split("\n") if x]
    assert markup.article_of(None) == ""


def test_names_by_all_pairs(spark):
    rng = random.Random(2)
    words = ["the", *(f"word{k}" for k in range(30))]
    name = lambda: "_".join(["the", *(rng.choice(words) for _ in range(rng.randint(0, 7)))])
    files, works = [name() for _ in range(60)], [name() for _ in range(60)]
    of = lambda x: set(x.replace("_", " ").split())
    want = {}
    for f in set(files):
        found = [(len(of(f) & of(w)) / max(len(of(f)), len(of(w))), w) for w in works if len(of(f) & of(w)) >= 2]
        found = [x for x in found if x[0] >= 0.3]
        if found:
            want[f] = max(found)[::-1]
    got = documents.match_files(spark.createDataFrame([(f,) for f in files], "file string").distinct(), spark.createDataFrame([(w,) for w in works], "work string"))
    assert {r["file"]: (r["work"], r["score"]) for r in got.collect()} == want and len(want) > 20
