"""Whole operators against plain Python, and the plumbing below them."""

import math
import random
import re
import zlib
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refsift.llm import common, exact_dedup, html_text, near_dedup, ordered, quality, url_filter
from refsift.llm.components import components
from refsift.llm.textvec import string_buffers

SF = "/root/testdata/sf0.01"


def url_parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", "")


def neighbours(pages):
    """Each page with its neighbours in path order of the host, the nearer first."""
    rows = sorted(pages, key=lambda r: (*url_parts(r["url"]), r["page_id"]))
    for i, r in enumerate(rows):
        host, path = url_parts(r["url"])
        near = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows) and url_parts(rows[j]["url"])[0] == host]
        yield r, sorted(near, key=lambda x: -len(commonprefix([url_parts(x["url"])[1], path])))


def test_differencing_decides_on_the_tables(spark, monkeypatch):
    """Each page against its neighbours in plain Python; against a page of no template not one page would be right, and
    no element's name is used but on hosts of one page."""
    monkeypatch.setattr(html_text, "ROWS", 20)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    known = {re.sub(r"\s", "", r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}

    def right(lines):
        return re.sub(r"\s", "", "".join(b.text for b in lines[1:])) in known

    alone = 0
    for page, near in neighbours(pages.collect()):
        own, others = html_text.blocks(page["html"]), [html_text.blocks(x["html"]) for x in near]
        title = html_text.title_of(page["html"])
        copies = tuple(html_text.title_of(x["html"]) == title for x in near)
        want = html_text.differenced(own, others, copies)
        r = got[page["page_id"]]
        assert (r["text"], r["n_shared"], r["n_named"]) == ("\n\n".join(b.text for b in want.lines), want.shared, want.named)
        assert right(want.lines) and r["n_chars"] == len(r["text"]) and not right(html_text.differenced(own, [html_text.blocks("<p>x</p>")]).lines)
        if near:
            assert want.shared > 0 == want.named
        else:
            alone += 1
            assert want.named > 0 == want.shared
    assert 0 <= alone < 0.2 * len(got)


def test_furniture_is_compared_by_its_place():
    def page(menu, advert, text, mark="div"):
        return html_text.blocks(f"<nav><ul>{''.join(f'<li>{m}' for m in menu)}</ul></nav>{advert}<{mark}>{text}</{mark}><p>Imprint</p>")

    one, two = page(["a", "b"], "", "<p>the first of all pages"), page(["c", "d", "e"], "<div class=ad>buy</div>", "<p>the second of them")
    told = html_text.differenced(two, [one])
    assert [b.text for b in told.lines] == ["buy", "the second of them"] and (told.shared, told.named) == (4, 0)
    third = page(["f"], "<div class=ad>sell</div>", "<p>the third")
    assert [b.text for b in html_text.differenced(two, [one], further=[one, third]).lines] == ["the second of them"]
    marked = [page(["a"], "<p>teaser", t, "article") for t in ("<p>one<p>both", "<p>two<p>both")]
    assert [b.text for b in html_text.differenced(marked[0], [marked[1]]).lines] == ["one", "both"]
    assert [b.text for b in html_text.differenced(marked[0], [[]]).lines] == ["a", "teaser", "one", "both", "Imprint"]
    assert [b.text for b in html_text.differenced(marked[0], [[]], further=[marked[1]]).lines] == ["one", "both"]
    assert [b.text for b in html_text.differenced(marked[0], []).lines] == ["one", "both"]


def levels_by_hand(outcomes):
    """The posteriors in plain Python: share and bound by host, domain, suffix and of the root."""
    hosts = {}
    for host, bad in outcomes:
        if bad is not None:
            n, k = hosts.get(host, (0, 0))
            hosts[host] = n + 1, k + bad

    def domain(h):
        parts = h.split(".")
        deep = len(parts) >= 3 and len(parts[-1]) == 2 and parts[-2] in url_filter.SECOND_LEVEL
        return ".".join(parts[-3 if deep else -2 :])

    def suffix(d):
        return d.split(".", 1)[1] if "." in d else d

    def summed(counts, key):
        out = {}
        for x, (n, k) in counts.items():
            a, b = out.get(key(x), (0, 0))
            out[key(x)] = a + n, b + k
        return out

    domains = summed(hosts, domain)
    suffixes = summed(domains, suffix)
    n, k = (sum(c[i] for c in hosts.values()) for i in (0, 1))
    root = (k + 1) / (n + 2), n + 2

    def weight(counts, prior):
        total = sum(n for n, _ in counts.values())
        spread = sum(n * (k / n - prior(x)) ** 2 for x, (n, k) in counts.items()) / total
        noise = sum(prior(x) * (1 - prior(x)) for x in counts) / total
        level = sum(n * prior(x) * (1 - prior(x)) for x, (n, _) in counts.items()) / total
        raw = level / (spread - noise) - 1 if spread > noise else url_filter.MOST
        return min(max(raw, url_filter.LEAST), url_filter.MOST)

    def shrunk(counts, prior, w):
        return {x: ((k + w * prior(x)) / (n + w), n + w) for x, (n, k) in counts.items()}

    def posterior(m, size):
        a, b = m * size, (1 - m) * size
        return m, m - url_filter.BOUND * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))

    w_suffix = weight(suffixes, lambda x: root[0])
    s = shrunk(suffixes, lambda x: root[0], w_suffix)
    w_domain = weight(domains, lambda x: s[suffix(x)][0])
    d = shrunk(domains, lambda x: s[suffix(x)][0], w_domain)
    w_host = weight(hosts, lambda x: d[domain(x)][0])
    h = shrunk(hosts, lambda x: d[domain(x)][0], w_host)

    def unseen(m, size, weights):
        kept = size / (size + 1)
        for w in weights:
            kept *= w / (w + 1)
        return posterior(m, kept / (1 - kept))

    def told(host):
        if host in h:
            return posterior(*h[host])
        if domain(host) in d:
            return unseen(*d[domain(host)], [w_host])
        if suffix(domain(host)) in s:
            return unseen(*s[suffix(domain(host))], [w_domain, w_host])
        return unseen(*root, [w_suffix, w_domain, w_host])

    return told, (w_suffix, w_domain, w_host)


@pytest.mark.parametrize("seed", (1, 2))
def test_host_reputation_by_hand(spark, seed):
    rng = random.Random(seed)
    outcomes = []
    for i in range(8):
        for j in range(rng.randint(1, 3)):
            share = rng.random() ** 2
            outcomes += [(f"h{j}.d{i}.{rng.choice(('org', 'ru', 'co.uk'))}", rng.choice((int(rng.random() < share), None))) for _ in range(rng.randint(1, 40))]
    told, weights = levels_by_hand(outcomes)
    assert all(url_filter.LEAST <= w <= url_filter.MOST for w in weights)
    hosts = sorted({h for h, _ in outcomes}) + ["new.d1.org", "x.d2.co.uk", "q.unknown.ru", "a.b.zz", "localhost", ""]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(outcomes, "host string, bad int"), rules=()).collect()}
    for i, h in enumerate(hosts):
        share, bound = told(h)
        assert got[i]["share"] == pytest.approx(share) and got[i]["bound"] == pytest.approx(bound)
        assert got[i]["verdict"] == ("block" if bound > url_filter.LIMIT else "allow") and got[i]["rule"] is None


def test_outcomes_of_the_tables(spark):
    """Labelled pages by plain Python; a host whose outcomes are turned bad is blocked, the others keep their verdict."""
    pages, docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents", "labels"))
    marks = {}
    for r in labels.collect():
        if r["quality"] is not None or r["toxic"] is not None:
            marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), int(r["toxic"] == 1 or r["quality"] == 0))
    by_text = {}
    for r in docs.collect():
        if r["doc_id"] in marks:
            key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
            by_text[key] = max(by_text.get(key, 0), marks[r["doc_id"]])
    want = []
    for r in pages.collect():
        lines = html_text.main_text(html_text.blocks(r["html"]), [])
        key = re.sub(r"[\x20\x09-\x0D]", "", "".join(b.text for b in lines if b.tag not in ("h1", "h2", "title")))
        if key in by_text:
            want.append((url_parts(r["url"])[0], by_text[key]))
    outcomes = url_filter.labelled(pages, docs, labels)
    assert sorted((r["host"], r["bad"]) for r in outcomes.collect()) == sorted(want) and len(want) > 50
    before = {r["page_id"]: r for r in url_filter.judge(pages, outcomes).collect()}
    free = [r["host"] for r in before.values() if r["rule"] is None]
    worst = max(set(free), key=lambda h: (sum(x == h for x, _ in want), h))
    changed = outcomes.withColumn("bad", F.when(F.col("host") == worst, 1).otherwise(F.col("bad")))
    many = changed.where(F.col("host") == worst).crossJoin(spark.range(20)).select("host", "bad")
    after = {r["page_id"]: r for r in url_filter.judge(pages, changed.unionByName(many)).collect()}
    assert all(r["verdict"] == "block" for r in after.values() if r["host"] == worst and r["rule"] is None)
    assert all(r["verdict"] == before[i]["verdict"] for i, r in after.items() if r["rule"] is not None)


def test_quality_by_hand(spark, monkeypatch):
    """Context sums, pooling, both layers and the temperature, word by word."""
    rng = random.Random(31)
    good, bad = ["alpha", "Beta", "gamma"], ["X9!", "zzz", "##"]
    rows = [" ".join(rng.choice((good, bad)[i % 2] + ["und", "so"]) for _ in range(rng.randint(1, 25))) for i in range(300)] + ["", "und"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(300)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0}

    def streams(text):
        data, at = string_buffers(pa.array([text]))
        return [x.tolist() for x in quality.tokens(data, at)[:2]]

    vectors = []
    for kind, (buckets, seed) in enumerate(((quality.WORD_BUCKETS, 43), (quality.SHAPE_BUCKETS, 47))):
        draws = quality.Contexts(buckets, seed)

        def index(t, draws=draws):
            v = np.zeros(quality.DIM)
            for place, sign in zip(draws.places[t], draws.signs[t], strict=True):
                v[place] += sign
            return v

        found = {t: index(t) for row in rows for t in streams(row)[kind]}
        for i, row in enumerate(rows):
            stream = streams(row)[kind]
            for a, t in enumerate(stream):
                for b in range(max(0, a - quality.REACH), min(len(stream), a + quality.REACH + 1)):
                    if a != b and i not in held:
                        found[t] = found[t] + index(stream[b])
        vectors.append({t: v / max(1e-6, np.linalg.norm(v)) for t, v in found.items()})
    x = {i: np.concatenate([np.mean([vectors[kind][t] for t in streams(row)[kind]], axis=0) for kind in (0, 1)]) for i, row in enumerate(rows) if row}
    net = model.network
    used = [i for i in range(300) if i not in held]
    assert net.mean == pytest.approx(np.mean([x[i] for i in used], axis=0), abs=1e-5)

    def logit(i):
        hidden = np.tanh((x[i] - net.mean) / net.scale @ net.w[0] + net.w[1])
        return float(hidden @ net.w[2] + net.w[3][0])

    for i in range(len(rows)):
        want = 1 / (1 + math.exp(-logit(i) / net.temperature)) if rows[i] else 0.0
        assert got[i] == pytest.approx(want, abs=2e-4)
    apart = np.random.default_rng(7).permutation(len(used))[: len(used) // 5]
    truth = [(logit(used[k]), (used[k] + 1) % 2) for k in apart]

    def loss(t):
        return sum(math.log1p(math.exp(-z / t)) if y else math.log1p(math.exp(z / t)) for z, y in truth)

    assert loss(net.temperature) <= min(loss(t) for t in (0.5, 0.8, 1, 1.5, 2, 4)) + 1e-3
    assert np.mean([(got[i] >= 0.5) == ((i + 1) % 2 == 1) for i in held if i < 300]) > 0.8


def test_exact_dedup_of_any_ids(spark):
    """Strings, the smallest long, and repeated rows."""
    rows = [("b", "x y"), ("a", "xy"), ("c", "x  y"), (None, "x   y"), ("d", "z"), ("d", "z"), ("d", "q"), (None, "n"), (None, "n"), ("e", "q")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id string, text string, kept string")
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.resolve(df).collect()]
    assert sorted(got, key=str) == sorted([*[(i, None, 4, i is None) for i in ("a", "b", "c", None)], *[("d", "d", 2, True)] * 2, ("d", "d", 2, True), ("e", "d", 2, False), *[(None, None, 2, True)] * 2], key=str)
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(None, "x   y"), ("d", "z"), ("d", "q"), (None, "n")], key=str)
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "x"), (5, "x"), (5, "x"), (least, "y"), (7, "y ")], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(df).collect()} == {(least, "x"), (7, "y ")} and exact_dedup.deduplicate(df).count() == 2


def test_near_dedup_of_odd_ids(spark):
    with pytest.raises(TypeError):
        near_dedup.link(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    text = "one two three four five six seven"
    df = spark.createDataFrame([(3, text, "a"), (3, text, "a"), (4, text + "!", "b"), (9, "other", "c"), (9, "words", "d"), (None, text, "e")], "doc_id int, text string, kept string")
    left = [(r["doc_id"], r["kept"]) for r in near_dedup.deduplicate(df).collect()]
    assert len(left) == 4 and {i for i, _ in left} == {3, 4, 9, None}


@pytest.mark.parametrize(("rows", "wrap"), [(1, True), (3, False), (50, True)])
def test_neighbours_in_order(spark, rows, wrap):
    """Every row sees the rows before and after it, whatever the ranges; ties, nulls and one-row tables too."""
    rng = random.Random(rows)
    keys = [rng.choice((None, *range(12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, k int").repartition(4)
    space = common.Workspace(spark, "test")
    spread, n = ordered.dealt(df, F.struct("k", "id"), rows, space, before=True, after=True, wrap=wrap)
    here = ordered.within()
    both = spread.withColumns({"after": F.lead("id").over(here), "before": F.lag("id").over(here)}).where("_rs_ghost = 0").collect()
    order = sorted(range(40), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    got = {r["id"]: r for r in both}
    assert n == -(-40 // rows) and len(both) == 40
    for a, b in zip(order, order[1:], strict=False):
        assert got[a]["after"] == b and got[b]["before"] == a
    if not wrap:
        assert got[order[-1]]["after"] is None
    assert got[order[0]]["before"] is None
    assert ordered.dealt(df.limit(0), F.struct("k", "id"), rows, space, before=True, after=True, wrap=wrap)[0].collect() == []


def test_equal_keys_lie_in_one_range(spark):
    df = spark.createDataFrame([(7, i) for i in range(100)] + [(8, 0)], "k int, other int").repartition(3)
    spread, _ = ordered.dealt(df, F.struct("k"), 4, common.Workspace(spark, "test"), before=False, after=False, wrap=False)
    assert spread.where("k = 7").select("_rs_range").distinct().count() == 1 and spread.count() == 101


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (300, 301), (301, 300), (300, 301)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(60)]  # a chain and a star
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    space = common.Workspace(spark, "test")
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long"), space).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long"), space).collect() == []
    assert components(spark.createDataFrame([(4, 4)], "a long, b long"), space).collect() == []


def test_shared_folder_is_needed_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


