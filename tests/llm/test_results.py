"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import struct
import zlib
from itertools import combinations
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from refsift.llm import exact_dedup, fingerprints, html_text, language_id, near_dedup, packing, pieces, quality, queries, sharding, url_filter
from refsift.llm.bytebpe import ByteBPE
from refsift.llm.queries import vocabulary
from refsift.llm.textvec import Words, shingle_hashes, string_buffers

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ro", "sa", "ti", "ve", "n", "r")]


def texts(seed, n, least=0, most=60):
    """Random texts, some of them edits and copies of others."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split(" ")
            for _ in range(rng.choice((0, 1, 1, 2, 6))):
                words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
            out.append(rng.choice((" ", "\n", "  ")).join(words) if rng.random() < 0.1 else " ".join(words))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def lowered(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components_of(rows):
    sets = [shingle_set(t) for t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(rows))], sets


@pytest.mark.parametrize("seed", (1, 2))
def test_near_dedup(spark, monkeypatch, seed):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)  # hot keys in several blocks
    rows = texts(seed, 160)
    want, sets = components_of(rows)
    got = {r["doc_id"]: r for r in near_dedup.link(frame(spark, rows)).collect()}
    assert [got[i]["component_id"] for i in range(len(rows))] == want
    assert [got[i]["n_shingles"] for i in range(len(rows))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_multi_index_guarantee():
    """Signatures that differ in up to CHUNKS * (ERRORS + 1) - 1 symbols share a key."""
    rng = np.random.default_rng(3)
    most = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    a = rng.integers(0, 65536, (200, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SYMBOLS, most, replace=False)] ^= 1
    assert all(set(x) & set(y) for x, y in zip(near_dedup.keys(a).tolist(), near_dedup.keys(b).tolist(), strict=True))


def test_pairs_within_the_guaranteed_distance_are_confirmed():
    """However much the other symbols differ."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 65536, (300, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k, row in enumerate(b):
        row[rng.choice(near_dedup.SYMBOLS, near_dedup.SURE + (k >= 200), replace=False)] ^= 1
    rest = rng.integers(0, 256, (300, near_dedup.MORE)).astype(np.uint8)
    assert near_dedup.near((a, rest), (b, rest ^ 1)).tolist() == list(range(200))
    both = np.concatenate([a, b])
    shared = [set(x) & set(y) for x, y in zip(near_dedup.keys(a).tolist(), near_dedup.keys(b).tolist(), strict=True)]
    rows = []
    for k in range(200):
        for key in sorted(shared[k]):
            rows += [(key, k, both[k], bytes(near_dedup.WIDE)), (key, 1000 + k, b[k], b"\1" * near_dedup.WIDE)]
    rows.sort(key=lambda r: (r[0], r[1]))
    columns = [pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)), *[pa.array([0] * len(rows), pa.int32())] * 3]
    columns += [*[pa.array([r[1] for r in rows], pa.int64())] * 2, pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "one", "two", "block", "rep", "comp", "first", "wide"])
    found = [(x, y) for out in near_dedup._across(iter([batch])) for x, y in zip(*(out.column(c).to_pylist() for c in (0, 1)), strict=True)]
    assert sorted(found) == [(k, 1000 + k) for k in range(200)]  # each once


def test_texts_with_a_common_passage(spark, monkeypatch):
    """Many texts of one template, some of them near-duplicates: the template's keys are cut into blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(14)
    passage = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for i in range(70):
        if i % 7 == 6:
            words = rows[-1].split(" ")
            words[-3] = "edited"
            rows.append(" ".join(words))
        else:
            rows.append(" ".join(passage + [rng.choice(WORDS) for _ in range(rng.choice((12, 16, 30)))]))
    want, _ = components_of(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want and len(set(want)) < len(rows)


def test_pairs_of_groups():
    sizes = np.array([1, 4, 2, 7])
    got = sorted((int(i), int(j)) for a, b in near_dedup._of_groups(sizes, 5) for i, j in zip(a, b, strict=True))
    ends = np.cumsum(sizes)
    assert got == sorted(p for e, n in zip(ends, sizes, strict=True) for p in combinations(range(e - n, e), 2))


def test_shingles_of_whole_texts():
    rows = [None, "", "  ", "a", "A b\tc\nd", "a b c d e", "é b c d e f\x0bg", "x " * 5000, "a b c d\x1ce f"]
    words = Words(*string_buffers(pa.array(rows, pa.string())))
    hashes, at = shingle_hashes(words)
    assert [len(set(hashes[at[i] : at[i + 1]].tolist())) for i in range(len(rows))] == [len(shingle_set(t)) for t in rows]


def test_exact_dedup(spark):
    rows = texts(5, 120) + ["", " ", None, "a b", "ab", "a  b"]
    got = {r["doc_id"]: r for r in exact_dedup.resolve(frame(spark, rows), tracked=16, heavy=3).collect()}
    same = {}
    for i, t in enumerate(rows):
        same.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    for norm, ids in same.items():
        keep = min(ids, key=lambda i: (-len(rows[i] or ""), i))
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(frame(spark, rows)).collect()) == sorted(i for i in got if got[i]["kept"])


def test_language_entropy_by_brute_force():
    samples = {"x": "abra kadabra alakazam", "y": "lorem ipsum dolor sit amet"}
    model = language_id.Model(samples)
    some = ["Kadabra!", "dolor, lorem 12 amet", "zzz", "abra " * 200, "a", "", None, "123"]
    rng = random.Random(12)
    some += ["".join(rng.choice(("abra", "kada", "lorem ", "psu", "z", " ")) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    letters, bits = model.entropies(some)

    def symbols(t):
        return re.sub(r"[^a-z]+", " ", t.lower()).lstrip(" ")

    for i, t in enumerate(some):
        s = symbols(t or "")
        assert letters[i] == sum(c.isalpha() for c in s)
        for k, name in enumerate(sorted(samples)):
            sample = symbols(samples[name])
            phrases = here = 0
            while here < len(s):
                end = here + 1
                while end < len(s) and s[here : end + 1] in sample:
                    end += 1
                here, phrases = end, phrases + 1
            if letters[i]:
                assert bits[i, k] == pytest.approx(phrases * math.log2(len(sample)) / len(s))


def test_language_sample_is_of_many_texts(spark):
    """No long or repeated text fills a language's sample; every sampled text has a part in it."""
    assert [len(p) for p in language_id.parts(["a" * 5, "b" * 1000, "c" * 1000], 205)] == [5, 100, 100]
    rows = [(i, "hot text " * 1500, "xx") for i in range(100)] + [(100 + i, f"number{i:03d}x " * (i + 20), "xx") for i in range(200)]
    samples, clean = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    inside, apart = samples["xx"], set(clean["xx"])
    assert all(any(x in t for x in apart) != (t.split()[0] in set(inside.split())) for i, t, _ in rows if i not in held)
    assert inside.count("hot") < 0.1 * len(inside.split()) and len(inside) <= language_id.LETTERS + len(rows)


def test_language_of_long_texts_is_learned(spark):
    """No row is left out of the sample for its length, and its parts may come from anywhere in it."""
    rng = random.Random(9)

    def words(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))

    rows = [(i, words("abcdefgh", 9000), "long") for i in range(12)] + [(100 + i, words("qrstuvwx", 30), "short") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(r[1]) for r in rows[:12]) > 40_000
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    samples, _ = language_id.sample(docs)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    starts = [t.find(part) for i, t, _ in rows[:12] if i not in held for part in samples["long"].split("\n") if part in t]
    assert len(starts) >= 5 and max(starts) > 8192


def test_double_array():
    rng = np.random.default_rng(5)
    for size, n in ((4, 300), (3000, 2000)):
        symbols = rng.integers(0, size, n)
        nexts = language_id.suffix_automaton(symbols)
        places, end = language_id.places_of(nexts, size)
        used = [(places[s] + c) for s in range(1, len(nexts)) for c in nexts[s]]
        assert len(used) == len(set(used)) and max(used) < end <= 2 * len(used) + 2 * size
        inner = [places[s] for s in range(1, len(nexts)) if nexts[s]]
        assert len(inner) == len(set(inner)) and end not in inner


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language_id.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and n > 40").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in told) >= 0.98 * len(told) > 50
    for r in told[:20]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1


ODD = ["", " ", "  a  b ", "日本語 テキスト\n\t", "x" * 300, "é́ \U0001f600!", "abc" * 90 + " q", "▁x▁ ▁", "a     b", "it's 'll x", "12ab!? x 9٣z"]


def test_pieces_are_the_librarys():
    import sentencepiece

    proto = open(vocabulary("piece_bpe_32k.model"), "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    coder = pieces.Coder(proto)
    some = ODD + texts(7, 30)
    ids, at = coder.encode(some)
    data, ends = coder.decode(ids, at)
    for i, t in enumerate(some):
        own = ids[at[i] : at[i + 1]].tolist()
        assert data[ends[i] : ends[i + 1]].tobytes().decode() == t
        if "▁" not in t:
            assert own == library.encode(t) and library.decode(own) == t


def test_pieces_stream():
    coder = pieces.Coder(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice(["a", "th", "er", " ", "  ", "\n", "é", "ing", "日", "$"]) for _ in range(rng.randint(1, 200)))
        whole, parts, at = (" " + text).replace(" ", "▁"), [], 0
        stream = pieces.Stream(coder.v)
        while at < len(whole):
            step = rng.randint(1, 40)
            parts += stream.feed(whole[at : at + step])
            at += step
            assert len(stream.text) <= 12 * coder.v.longest  # bounded window
        assert parts + stream.end() == coder.encode([text])[0].tolist()


def test_byte_bpe_is_the_librarys():
    own = ByteBPE(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    some = ODD + texts(9, 20) + ["a \n b", "tab\t\tend \t", "x\u00a0 y", "\u3000z"]
    ids, at, _ = own.encode(some)
    for i, t in enumerate(some):
        assert ids[at[i] : at[i + 1]].tolist() == own.library.encode(t, add_special_tokens=False).ids
    assert own.merger is not None
    own.merger = None
    own._forget()
    assert own.encode(some)[0].tolist() == ids.tolist()


def test_best_cuts_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        limit = 16
        total = rng.randint(1, 60)
        docs = np.array(sorted({*rng.sample(range(1, total + 1), min(total, 3)), total}))
        stops = np.array(sorted(rng.sample(range(1, total + 1), min(total, 8))))
        places, penalty = packing.cut_places(total, docs, stops, stride=4)
        cuts = packing.best_cuts(places, penalty, limit)

        def cost(path):
            out = 0
            for a, b in zip(path, path[1:], strict=False):
                size = int(places[b] - places[a])
                assert size <= limit
                out += (0 if size & (size - 1) == 0 else limit - size) + int(penalty[b]) + packing.EACH
            return out

        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + cost([i, j]) for i in range(j) if places[j] - places[i] <= limit)
        assert cost(cuts) == best[len(places) - 1]


def test_every_sentence_end_is_a_cut_place():
    stops = np.array([3, 5, 6, 20, 21, 22, 23, 90])
    places, penalty = packing.cut_places(100, np.array([50, 100]), stops)
    assert set(stops) <= set(places.tolist())
    assert all(penalty[np.searchsorted(places, s)] == packing.SENTENCE for s in stops)


def test_packing_contract(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 6000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json")).collect()
    library = ByteBPE(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read()).library
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d in docs.collect():
        ids = np.array([*library.encode(d["text"], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.08 * sum(r["length"] for r in rows)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    told = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in told)
    assert right >= 0.93 * len(told) > 30 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in told)


def test_quality_vectors_of_all_texts(spark, monkeypatch):
    """Every text outside the held-out fifth adds to the vectors, long ones included, however the rows are dealt."""
    rows = texts(21, 2500, least=1, most=12) + ["farword nextword " * 2000]
    held = {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0}
    if len(rows) - 1 in held:
        rows.insert(0, "one two")
        held = {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(rows[-1]) > 20_000 and len(rows) - 1 not in held
    used = [t for i, t in enumerate(rows) if i not in held]
    shipped_vectors = []
    monkeypatch.setattr(quality, "Model", lambda vectors, network, share: shipped_vectors.append(vectors))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    quality.fit(frame(spark, rows), labels)
    want = {}
    for t in used:
        data, at = string_buffers(pa.array([t]))
        stream = quality.tokens(data, at)[0].tolist()
        for i, w in enumerate(stream):
            for other in stream[max(0, i - quality.REACH) : i] + stream[i + 1 : i + 1 + quality.REACH]:
                want.setdefault(w, []).append(other)
    draws = quality.Contexts(quality.WORD_BUCKETS, 43)
    for w, others in want.items():
        v = np.zeros(quality.DIM)
        for other in [w, *others]:
            np.add.at(v, draws.places[other], draws.signs[other])
        assert np.allclose(shipped_vectors[0].words[w], v / max(1e-6, np.linalg.norm(v)), atol=1e-5)


def test_quality_first_layer_is_linear():
    rng = np.random.default_rng(1)
    some = texts(11, 60, least=1)
    vectors = quality.Vectors(some)
    data, at = string_buffers(pa.array(some))
    x = vectors.pool(data, at)
    y = (rng.random(60) < 0.5).astype(float)
    network = quality.Network(x.astype(float), y)
    model = quality.Model(vectors, network, 0.5)
    z = (x - network.mean) / network.scale
    assert np.allclose(model.score(data, at), quality._sigmoid(network._logits(z) / network.temperature), atol=1e-4)


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>HERE"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav><p>menu</p></nav><article><h1>Head &amp; co</h1><p><b>a\n b<br>c<br><p>d&nbsp;e</article><footer>f</footer>", "Head & co\n\na b c\n\nd e"),
        ('<div class="ad">buy</div><main><p>x</p><div id="comments">c</div><aside>s</aside><form>q</form><p>y</main>', "x\n\ny"),
        ("<header>h</header><p>only</p><div class='cookie-notice'>n</div><div class=related>z</div>", "only\n\nz"),
        ("<nav>never closed<article>a<!-- <p>no</p> --><p>b</article>", "a\n\nb"),
        ("<article><header><h1>title</h1></header><p>1 &lt; 2 <a href='x>y'>go</a></p></article>", "title\n\n1 < 2 go"),
        ("<article><ul><li>one<li>two</ul><div id=login>h</div><button>b</button></article></body></html>", "one\n\ntwo\n\nh\n\nb"),
        ("<article><p>one <span class='ad'>buy</span>two <svg><text>x</text></svg>three<em>!</em></p></article>", "one two three!"),
        ("<article><p>one<b><div class='ad'>buy</b>two</article>", "one\n\ntwo"),
        ("", ""),
        ("plain <i>te</i>xt", "plain text"),
    ],
)
def test_markup(html, text):
    found = html_text.main_text(html_text.blocks(PAGE.replace("HERE", html)), [])
    assert "\n\n".join(b.text for b in found) == text


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = sorted(html_text.shared(a, b))
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in rest for i in got)


def test_page_differencing(spark, monkeypatch):
    """Template lines go, whatever range of the order a page falls into; copies of an article stay."""
    monkeypatch.setattr(html_text, "ROWS", 3)
    rows = [(i, f"http://h{i % 3}.example.org/{i % 2}/{i:03d}", f"<p>top of the site</p><p>own text of page {i}, long enough to count</p><p>bottom</p>") for i in range(40)]
    rows += [(100 + i, f"http://copy.example.org/{i}", "<p>the same article at two places</p>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own text of page {i}, long enough to count" for i in range(40))
    assert got[100] == got[101] == "the same article at two places"


def test_short_pages_of_a_large_template(spark, monkeypatch):
    """Blocks that both neighbours share go even if they are most of the page; edited copies of one title stay whole."""
    monkeypatch.setattr(html_text, "ROWS", 3)
    top, bottom = "".join(f"<p>entry {k} of the long menu of this site</p>" for k in range(8)), "<p>imprint, contact and all rights reserved</p>"
    rows = [(i, f"http://h.example.org/a/{i:03d}", f"<title>page {i}</title>{top}<p>news {i}</p>{bottom}") for i in range(20)]
    rows += [(100 + i, f"http://copy.example.org/{i}", f"<title>story</title><p>the same long article at five places</p><p>seen {i}</p>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"news {i}" for i in range(1, 19))  # the host's ends have one neighbour
    assert all(got[100 + i] == f"the same long article at five places\n\nseen {i}" for i in range(5))


def test_pages_of_the_tables(spark):
    """Every article's paragraphs are a document's lines."""
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    known = {re.sub(r"\s", "", r["text"]) for r in docs.collect()}
    for r in html_text.extract(pages).collect():
        head, _, rest = r["text"].partition("\n\n")
        assert re.sub(r"\s", "", rest) in known and r["n_chars"] == len(r["text"])


def test_url_rules(spark):
    urls = ["https://www.example.com/en/1?x", "http://EXAMPLE.com/en/", "http://a.example.com/en/2", "http://example.com/de/", "http://x.net/es/1", "http://x.net/en/1", "http://notnet/es/", "http://com", "http://net/fr/#a", "//a/b", "x://y://z/q", None]
    want = ["www.example.com/en/", "example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, "net/fr/", None, None, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([], "host string, bad int")).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == want
    assert [got[i]["verdict"] for i in range(5)] == ["allow", "block", "block", "allow", "block"]
    assert (got[10]["host"], got[10]["path"], got[7]["path"]) == ("y:", "//z/q", "")


def test_host_reputation(spark):
    rng = random.Random(6)
    rows = [(f"bad{i}.spam.org", 1) for i in range(6) for _ in range(30)] + [(f"h{i}.fine{i % 4}.org", int(rng.random() < 0.1)) for i in range(12) for _ in range(30)] + [("new.spam.org", 1)]
    got = {r["host"]: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert all((got[h]["bound"] > url_filter.LIMIT) == ("spam" in h) for h in got if got[h]["n"] > 1)
    assert got["new.spam.org"]["share"] > 0.5  # shrunk to its domain
    one = got["bad0.spam.org"]
    assert 0 < one["bound"] < one["share"] < 1


def test_unseen_hosts_inherit(spark):
    """A host without outcomes is judged by its domain, else by its suffix, else by the root."""
    rows = [(f"bad{i}.spam.org", 1) for i in range(6) for _ in range(30)] + [(f"h{i}.fine{i % 4}.org", 0) for i in range(12) for _ in range(30)]
    rows += [(f"h{i}.d{i}.ru", 1) for i in range(20) for _ in range(30)]
    urls = ["http://new.spam.org/1", "http://new.fine1.org/1", "http://a.unseen.ru/1", "http://a.unseen.org/1", "http://a.b.zz/1", None, "http://bad0.spam.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, outcomes).collect()}
    assert [got[i]["verdict"] for i in range(7)] == ["block", "allow", "block", "allow", "allow", "allow", "block"]
    assert all(0 < got[i]["bound"] < got[i]["share"] < 1 or got[i]["share"] < 0.5 for i in got)
    assert got[0]["bound"] <= got[6]["bound"] and got[2]["share"] > 0.5 > got[3]["bound"]
    assert got[4]["share"] == got[5]["share"] == pytest.approx((sum(b for _, b in rows) + 1) / (len(rows) + 2))
    assert {r["verdict"] for r in url_filter.judge(pages, outcomes.limit(0)).collect()} == {"allow"}


def test_lookup_table():
    names = sharding.shard_names(10)
    owner = sharding.lookup_table(names, 1009)
    counts = np.bincount(owner, minlength=10)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 9)
    assert moved < 0.1 * 1009
    double = np.bincount(sharding.lookup_table(names, 1009, [2] + [1] * 9), minlength=10)
    assert abs(double[0] - 2 * 1009 / 11) <= 2
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 101), (7, 13), (256, 65537)])
def test_lookup_table_by_whole_permutations(n, slots):
    """The published fill, written out: every shard's whole permutation, and turns until no slot is free."""
    names = sharding.shard_names(n)
    digests = [hashlib.md5(x.encode()).hexdigest() for x in names]
    want = [None] * slots
    orders = []
    for d in digests:
        offset, skip = int(d[:16], 16) % slots, int(d[16:], 16) % (slots - 1) + 1
        orders.append(iter(range(offset, offset + slots * skip, skip)))
    for turn in range(slots):
        slot = next(s % slots for s in orders[turn % n] if want[s % slots] is None)
        want[slot] = turn % n
    assert sharding.lookup_table(names, slots) == want


def test_sharding_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "old"), (None, "b", "old")], "doc_id long, text string, shard string")
    got = sharding.place(df, F.col("doc_id"), sharding.shard_names(4), slots=101)
    assert got.columns == ["doc_id", "text", "shard_input", "slot", "shard"] and got.count() == 2
    assert {r["shard_input"] for r in got.collect()} == {"old"}
    odd = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, Slot string, slot_input string, SHARD string")
    row = sharding.place(odd, F.col("doc_id"), sharding.shard_names(4), slots=101).first().asDict()
    assert [*row] == ["doc_id", "Slot_input_", "slot_input", "SHARD_input", "slot", "shard"] and [*row.values()][1:4] == ["a", "b", "c"]
    assert got.where("doc_id is null").first()["slot"] == int(hashlib.md5(b"").hexdigest()[:15], 16) % 101


def test_fingerprints(spark):
    rows = texts(13, 50, least=1, most=90) + ["", "é" * 7]
    ids = [3 * i + 1 for i in range(len(rows))]
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string").repartition(4)
    near = {r["doc_id"]: r for r in fingerprints.with_next(df, rows=4).collect()}  # many ranges
    assert [near[i]["next_text"] for i in ids] == rows[1:] + rows[:1]
    got = {r["doc_id"]: r for r in fingerprints.compare(df).collect()}

    def grams(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    def hashed(seed, *values):
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
        return seed - (seed >> 63 << 64)

    def naive(t):
        words = [hashed(42, w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())]
        found = set()
        for k in range(len(words) - 4):
            found.add(hashed(42, *words[k : k + 5]))
        if 0 < len(words) < 5:
            one = 0
            for w in words:
                one = hashed(42, one, w)
            found.add(one)
        assert len(found) == len(grams(t))
        return sorted(found)[: fingerprints.K]

    def likeness(a, b):
        x, y = naive(a), naive(b)
        least = sorted({*x, *y})[: fingerprints.K]
        return sum(h in x and h in y for h in least) / len(least) if least else 1.0

    def truth(a, b):
        x, y = grams(a), grams(b)
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, (t, nxt) in enumerate(zip(rows, rows[1:] + rows[:1], strict=True)):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[ids[i]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h % (1 << 64):016x}" for h in naive(t)) and r["edited_fingerprint"] == "".join(f"{h % (1 << 64):016x}" for h in naive(edited))
        assert r["near_edited"] == pytest.approx(likeness(t, edited)) and r["near_next"] == pytest.approx(likeness(t, nxt))
        assert abs(r["near_edited"] - truth(t, edited)) < 0.2  # over 4 standard deviations of an estimate of 128 hashes
        if len(grams(t)) < fingerprints.K:
            assert r["distinct_shingles"] == len(grams(t))


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[1000:])
    row = spark.createDataFrame([(a, b, a + " " + " ".join(words[4000:]))], "a string, b string, ab string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in ("a", "b", "ab")])
    got = row.select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"),
        fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
        fingerprints.distinct_count(F.col("a")).alias("n"),
        (fingerprints.merge(F.col("a"), F.col("b")) == F.col("ab")).alias("same"),
    ).first()
    assert abs(got["r"] - 0.5) < 0.15 and abs(got["c"] - 0.75) < 0.2 and abs(got["n"] / 3996 - 1) < 0.3 and got["same"]


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(queries.queries())
