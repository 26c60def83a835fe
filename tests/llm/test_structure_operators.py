"""HTML, media columns, SimHash, suffix arrays and the pipeline against brute force."""

import hashlib
import io
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwise.llm import queries
from cellwise.llm.components import smallest_reachable
from cellwise.llm.html_text import blocks_between, extract_pages, main_text
from cellwise.llm.media import area_resize, decode, difference_hash, encode_bmp, encode_pgm, image_tiles, media_features, text_media
from cellwise.llm.simhash import GrayIndex, block_masks, gray_rank, near_duplicates, one_of_each
from cellwise.llm.substring_dedup import remove_repeats
from cellwise.llm.suffix_array import permuted_prefixes, suffix_array

from edge_rows import EDGES

# HTML.

LONG = "A paragraph of an article, which is long enough to make a surge of text over a window of lines."


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><!-- nothing -->", ""),
        ("just text, no markup", "just text, no markup"),
        (f"<nav><p>Menu</p></nav><article><h1>Title</h1><p>{LONG}<p>Second &amp;  last\n&lt;line&gt;</article><footer>f</footer>", f"Title\n{LONG}\nSecond & last <line>"),
        (f"<body><div class='ad'>Buy</div><div><p>{LONG}</p><p>Short.</p></div><div id=comments><p>{LONG}</p></div></body>", f"{LONG}\nShort."),
        (f"<ul><li><a href=/>Home</a><li><a href=/x>About us</a></ul><p>{LONG}</p><script>var x = '<p>{LONG}</p>'</script>", LONG),
        (f"<main><p><b>{LONG}<br><p>After</p></main><aside>side</aside>", f"{LONG}\nAfter"),
        (f"<article><p>{LONG}</p><section class='reader-comments'><p>First!</p></section><form>name</form></article>", LONG),
        (f"<div class='page has-sidebar ad-free'><p>{LONG}</p><div class='sidebar-content'>x</div><div id='site-footer'>y</div></div>", LONG),
        (f"<article><p>{LONG} a < b &copy; &#8364; &bogus;</p><style>p{{}}</style></article", f"{LONG} a < b © € &bogus;"),
        (f"<article><p>{LONG}</p><h2 id='related-work'>Related work</h2><section id='social-science'><p>Some.</p></section><h2 id=share>Share</h2></article>", f"{LONG}\nRelated work\nSome.\nShare"),
        (f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div class='ad'><p>Buy</p><p>this</p><p>now</p></div><p>{LONG}</p></div>", "\n".join([LONG] * 5)),
        (f"<div><h2>Head</h2><p>{LONG}</p><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><p>The end.</p></div><ul><li><a href=/>Home</a></ul>", f"Head\n{LONG}\nThe end."),
        (f"<p title=\"the hidden class='ad' thing\">{LONG}</p><p hidden>No</p><p>it's <a href=it's>fine</a></p>", f"{LONG}\nit's fine"),
        (f"<p>{LONG}</p><div class='related-posts'><p>Other</p></div><div class='page-footer'>f</div><p id=footer>f</p>", LONG),
    ],
)
def test_main_text(html, expected):
    assert main_text(html) == expected


def test_pages(spark, data_dir):
    got = {r["page_id"]: r for r in queries.op4_html_extraction(spark, data_dir).collect()}
    pages = spark.read.parquet(f"{data_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search("(?s)<article>(.*?)</article>", p["html"])[1]
        parts = re.sub("<[^>]*>", "", re.sub("<(/?p|/?h1|br)>", "\x01", inside)).replace("&amp;", "&").replace("&quot;", '"').split("\x01")
        expected = "\n".join(filter(None, (" ".join(x.split()) for x in parts)))
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (expected, len(expected), p["url"])


def unmarked(r):
    """A page without article or main, and its text as it was put together: menus and notices around blocks of several kinds."""
    sentence = lambda n: " ".join(("word", "text", "line", "long", "page")[x] for x in r.integers(0, 5, n)).capitalize() + "."
    menu = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(n)) + "</ul>"
    truth, body = [], []

    def block(text, tag):
        truth.append(" ".join(text.split()))
        body.append(f"<{tag}>{text}</{tag}>")

    if r.random() < 0.7:
        block(sentence(4), "h1")
    for k in range(r.integers(2, 9)):
        block(sentence(r.integers(25, 90)), "p")
        kind = r.integers(0, 8)
        if kind == 0:
            body.append("<div class='ad'><p>Buy</p><p>one</p><p>now</p></div>")
        elif kind == 1:
            block(sentence(2), "h2")
        elif kind == 2:
            body.append("<ul>")
            for _ in range(r.integers(2, 5)):
                block(sentence(6), "li")
            body.append("</ul>")
        elif kind == 3:
            block(f"<a href='/x'>{sentence(3)}</a>", "p")
            truth[-1] = re.sub("<[^>]*>", "", truth[-1])
        elif kind == 4:
            block(sentence(5), "blockquote")
        elif kind == 5:
            body.append(menu(4))
    block(sentence(r.integers(25, 60)) if body[-1].startswith("<ul><li><a") else sentence(3), "p")
    inner = "".join(body)
    around = r.integers(0, 3)
    page = (f"<div id='content'>{inner}</div>", f"<div><div class='layout has-sidebar'>{inner}</div><div class='sidebar'><p>{sentence(40)}</p></div></div>", f"<table><tr><td>{menu(5)}</td><td>{inner}</td></tr></table>")[around]
    return f"<html><body><div class='nav-bar'>{menu(6)}</div>{menu(5)}{page}{menu(3)}<div id='footer'>© 2024 Some One</div><div class='cookie-notice'><p>{sentence(30)}</p></div></body></html>", "\n".join(truth)


def test_pages_without_article():
    r = np.random.default_rng(11)
    for _ in range(60):
        html, truth = unmarked(r)
        assert main_text(html) == truth


def test_runs_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(300):
        n = r.integers(1, 30)
        lengths = r.integers(1, 60, n) * (r.random(n) < 0.5)
        runs, now = [], []
        for i in range(n):
            if lengths[i]:
                now.append(i)
            elif now and not any(lengths[i : i + 3]):
                runs.append(now)
                now = []
        runs += [now] if now else []
        reach = lambda run: max(sum(lengths[max(i, 0) : i + 3]) for i in range(run[0] - 2, run[-1] + 1))
        high, low = blocks_between(lengths.astype(np.int64), 3, 60)
        assert sorted(high + low) == [(x[0], x[-1] + 1) for x in runs]
        assert high == [(x[0], x[-1] + 1) for x in runs if reach(x) >= 60]


def test_unclosed_elements_are_read_in_one_pass():
    import time

    began = time.process_time()
    assert main_text("<b>" * 8000 + "<div>" * 8000 + "text") == "text"
    assert time.process_time() - began < 1


def test_page_edges(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, "u", "<p>" * 5000 + "x" + "<div" * 2000, 3), (3, "u", "<p>&amp;" * 30000, 4)], "page_id long, url string, html string, text int")
    assert [r["n_chars"] for r in extract_pages(pages).orderBy(F.col("page_id").asc_nulls_first()).collect()] == [0, 0, 0, 1, 59999]
    assert extract_pages(pages.where("false")).count() == 0


# Media.


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.randoms(use_true_random=False))
def test_images_come_back(height, width, colour, random):
    pixels = np.array([random.randrange(256) for _ in range(height * width * (3 if colour else 1))], dtype=np.uint8).reshape((height, width, 3) if colour else (height, width))
    for encode in (encode_pgm, encode_bmp):
        assert (decode(encode(pixels)) == pixels).all() and decode(encode(pixels)).shape == pixels.shape


def test_plain_netpbm():
    assert decode(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert decode(b"P2 2 1 9\n3 9\n").tolist() == [[3, 9]]
    assert decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    for broken in (b"", b"P9 1 1", b"GIF89a", b"P5 1 1 255\n"):
        with pytest.raises(ValueError):
            decode(broken)


def test_area_means():
    a = np.arange(24 * 24).reshape(24, 24)
    assert np.allclose(area_resize(a, 8, 8), a.reshape(8, 3, 8, 3).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(a, 9, axis=0), 9, axis=1)
    assert np.allclose(area_resize(a, 8, 9), fine.reshape(8, 27, 9, 24).mean(axis=(1, 3)))
    assert difference_hash(np.tile(np.arange(24), (24, 1))).tobytes() == b"\xff" * 8


def brute_hash(image):
    """Whether each of 8 x 8 means is less than its right neighbour; means over the image blown up so that parts have whole pixels."""
    fine = np.repeat(np.repeat(image.astype(np.int64), 8, axis=0), 9, axis=1)
    sums = fine.reshape(8, len(fine) // 8, 9, fine.shape[1] // 9).sum(axis=(1, 3))
    bits = "".join("1" if a < b else "0" for row in sums for a, b in zip(row, row[1:]))
    return int(bits, 2).to_bytes(8, "big")


def test_media(spark, edges, none):
    rows = [*EDGES, (20, "".join(chr(33 + i * i % 90) for i in range(576 * 1024 + 700))), (21, "x" * 576), (22, "y" * 577)]
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(rows[len(EDGES) :], "doc_id long, text string"))
    expected = []
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 24)
        stored = b""
        for at in range(0, len(payload), 576 * 1024):
            buffer = io.BytesIO()
            np.save(buffer, np.frombuffer(payload[at : at + 576 * 1024], dtype=np.uint8).reshape(-1, 24, 24))
            stored += buffer.getvalue()
        tiles = b"".join(brute_hash(image[y : y + 24]) for y in range(0, len(image), 24))
        feature = f"{brute_hash(image).hex()}-{hashlib.sha256(tiles).hexdigest()[:16]}"
        expected.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
    assert sorted(map(tuple, media_features(text_media(docs)).collect()), key=repr) == sorted(expected, key=repr)
    assert media_features(text_media(none)).count() == 0


def test_tiles(spark):
    image = np.arange(30 * 50, dtype=np.int64).astype(np.uint8).reshape(30, 50)
    df = spark.createDataFrame([("a", bytearray(encode_pgm(image))), ("b", None), ("c", bytearray(b"no image"))], "name string, data binary")
    found = image_tiles(df, "name", "data").collect()
    assert {r["key"] for r in found if r["error"]} == {"b", "c"}
    back = np.zeros_like(image)
    for r in (r for r in found if r["key"] == "a"):
        tile = np.load(io.BytesIO(bytes(r["npy"])))
        back[r["y"] : r["y"] + tile.shape[0], r["x"] : r["x"] + tile.shape[1]] = tile
    assert (back == image).all()


# SimHash.


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    ids = sorted(prints)
    smallest = {i: i for i in ids}

    def find(i):
        while smallest[i] != i:
            i = smallest[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                smallest[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, data_dir, documents):
    prints = {d: fingerprint(t) for d, t in documents}
    expected = sorted((d, f"{p:016x}", c) for (d, p), c in zip(sorted(prints.items()), components(prints).values(), strict=True))
    assert sorted(map(tuple, queries.op9_simhash_near_dedup(spark, data_dir).collect())) == expected


def test_simhash_edges(spark, edges, none):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in near_duplicates(edges).collect()}
    assert got[1, "0" * 16] == got[2, "0" * 16] == got[3, "0" * 16] == 1
    assert got[4, f"{fingerprint(EDGES[0][1]):016x}"] == 0
    assert {v for (d, _), v in got.items() if d is None} == {None}
    assert near_duplicates(none).count() == 0


def test_spark_hashes_alike(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(0, 6))
def test_index_finds_all_links(seed, n, limit):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 2**63, 5, dtype=np.uint64)
    fps = centres[r.integers(0, 5, n)]
    for _ in range(3):
        fps = fps ^ np.where(r.random(n) < 0.6, np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    group = r.integers(0, 3, n)
    got = {tuple(sorted(p)) for a, b in GrayIndex(fps[:, None], group).links(limit) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= limit}


def test_two_errors_leave_a_mask():
    masks = block_masks(5, 3)
    assert len(masks) == 10 and all(any(not m & (1 << a | 1 << b) for _, m in masks) for a in range(64) for b in range(64))


def test_gray_rank():
    x = np.arange(64, dtype=np.uint64)
    assert (gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (300, 120), (300, 120)], "a long, b long")
    got = {r["node"]: r["component"] for r in smallest_reachable(edges).collect()}
    assert got == {**{i: 100 for i in [*range(100, 161), 300]}, **{i: 7 for i in [7, *range(200, 260)]}}
    assert smallest_reachable(edges.where("false")).count() == 0


def test_one_of_each(spark, edges):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:150], "changed", *words[151:]]
    other = [*words[:150], *(f"v{i}" for i in range(150))]
    texts = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(words)), (5, None), (6, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == [1, 3, 5]
    kept = one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([0, 1, 5, 6, 7, 8, None], key=repr)


def brute_one_of_each(texts, similarity=0.8):
    """The (id, text) that stay: components over exact Jaccard similarities of five-word shingles."""
    rows = sorted(set(texts), key=lambda r: (r[0] is None, r[0] or 0))
    split = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()} for w in split]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return sorted({label[i]: r for i, r in reversed(list(enumerate(rows)))}.values(), key=repr)


def near_texts():
    """Texts around the limit of similarity, in both directions, and a group that holds together by links."""
    r = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        words = [f"w{x}" for x in r.integers(0, 10**6, r.integers(20, 200))]
        texts.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            for at in r.integers(0, len(words), max(1, round(len(words) * r.choice([0.01, 0.02, 0.025, 0.04])))):
                words[at] = f"x{r.integers(0, 10**6)}"
            texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [500_000, 300])
def test_one_of_each_is_exact(spark, block):
    texts = near_texts()
    got = one_of_each(spark.createDataFrame(texts, "doc_id long, text string"), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_one_of_each(texts)


def test_one_of_each_keeps_rows_of_one_id(spark):
    """Texts under one id are no copies for that, their id's copies take no others along, and null ids are compared."""
    texts = [t for _, t in near_texts()[::4]]
    rows = [*((7, t) for t in texts[:10]), (7, texts[0]), (3, texts[1]), (None, texts[2]), (None, texts[20]), (None, texts[20]), (None, texts[21]), (9, texts[21])]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*((7, t) for t in texts[:10] if t != texts[1]), (3, texts[1]), (None, texts[20]), (9, texts[21])], key=repr)


# Suffix arrays.


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda k: st.lists(st.integers(1, k), max_size=90)))
def test_suffix_arrays(text):
    s = np.array([*text, 0], dtype=np.uint8)
    order = suffix_array(s, 41)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: bytes(s[i:]))
    padded = np.r_[s, np.zeros(24, dtype=np.uint8)]
    shared, by_place = permuted_prefixes(padded, order, 9)
    data = padded.tobytes()
    for n, rank in zip(shared.tolist(), by_place.tolist(), strict=True):
        a, b = int(order[rank]), int(order[rank - 1]) if rank else None
        assert n == (0 if b is None else next((k for k in range(9) if data[a + k] != data[b + k]), 9))


def test_suffix_arrays_of_many_names():
    """Long enough for several recursions, for batches of many buckets, and for long runs."""
    r = np.random.default_rng(1)
    vocabulary = ["".join(chr(97 + c) for c in r.integers(0, 20, r.integers(2, 9))) for _ in range(3000)]
    text = " ".join(vocabulary[i] for i in r.zipf(1.3, 20_000) % 3000) + "ab" * 300 + "word " * 200 + "a" * 500
    data = text.encode()
    order = suffix_array(np.r_[np.frombuffer(data, dtype=np.uint8).astype(np.uint16) + 1, np.uint16(0)], 257)
    assert order.tolist() == [len(data), *sorted(range(len(data)), key=lambda i: data[i : i + 2000])]


def brute_repeats(texts, width=50):
    ordered = sorted(((2**63 - 1 if d is None else d, (t or "").encode()) for d, t in texts))
    first = {}
    for d, data in ordered:
        for i in range(len(data) - width + 1):
            first.setdefault(data[i : i + width], d)
    out = []
    for d, data in ordered:
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if first[data[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((None if d == 2**63 - 1 else d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, data_dir, documents):
    assert sorted(map(tuple, queries.op10_suffix_array_dedup(spark, data_dir).collect()), key=repr) == brute_repeats(documents)


def test_repeat_edges(spark, edges, none):
    assert sorted(map(tuple, remove_repeats(edges).collect()), key=repr) == brute_repeats(EDGES)
    assert remove_repeats(none).count() == 0
    passage = "".join(chr(97 + i * 7 % 26) for i in range(25)) * 4
    texts = [(1, "x" * 49), (2, "x" * 50), (3, "y" + "x" * 50), (4, passage), (5, "é" * 25 + passage[3:60] + "é" * 30), (6, "é" * 60 + passage[:53]), (7, passage[:49]), (8, "a" * 5000), (9, "a" * 5000), (9, "a" * 400 + "b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for options in ({"bytes_per_task": 64}, {"bytes_per_task": 320}, {"bytes_per_task": 64, "most_buckets": 3}):  # crowded grams are split; more parts than buckets
        assert sorted(map(tuple, remove_repeats(docs, **options).collect()), key=repr) == brute_repeats(texts)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cellwise_classes")]


# The pipeline.


def test_pipeline(spark, data_dir):
    import corpus_pipeline as pipeline
    from test_text_operators import detected, words_of

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    items = [(r["item_id"], words_of(r["text"])) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for _, w in items if w for i in range(max(1, len(w) - 9))}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    seen = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, seen[-1], data_dir).cache()
        assert name and out.count() > 0
        seen.append(out)
    before, good, single, clean, private, packed = ({r["doc_id"]: r for r in df.collect()} for df in seen)
    assert [df.columns for df in seen[1:5]] == [docs.columns] * 4
    assert sum(good.keys() >= {d} for d, q in labels.items() if q) >= 0.95 * sum(labels.values())
    assert sum(d in good for d, q in labels.items() if not q) <= 0.2 * sum(not q for q in labels.values())
    same = defaultdict(list)
    for d, r in good.items():
        same[r["text"]].append(d)
    assert all(sum(d in single for d in ids) <= 1 for ids in same.values())
    hit = {d for d, r in single.items() for w in [words_of(r["text"])] for n in {len(g) for g in grams} if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1))}
    assert set(clean) == set(single) - hit
    assert set(private) == set(clean) and not any(detected(r["text"]) & detected(clean[d]["text"]) for d, r in private.items())
    assert all(r["n_chars"] == len(r["text"] or "") for r in private.values()) and set(packed) == set(private)
    assert pipeline.run(spark, data_dir).count() == seen[-1].count()


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_edges(spark, data_dir, tmp_path, some):
    """Nulls, empty texts, ties, repeated rows, an id with unlike texts and columns with names that stages use; and an empty table."""
    import corpus_pipeline as pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, k string, _key int, hit string, row int, _found string, component long, words int, done int"
    unlike = [(8, "another text under this id, which has nothing in common with the others and must stay where it is"), (None, None), (None, "a row that has no id and is like no other row in all of this small table")]
    rows = [(i, t, "en", None if i == 5 else "s", len(t or ""), "k", 1, "h", 2, "f", 3, 4, 5) for i, t in [*EDGES, *unlike]]
    docs = spark.createDataFrame(rows if some else [], names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        now = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        kept.append(now.count())
        assert k == 4 or now.columns == docs.columns
    assert kept[4] >= kept[3] == kept[2] <= kept[1] <= kept[0] <= len(rows) * some
    if some:
        judged = [r["text"] for r in spark.read.parquet(f"{tmp_path}/0-quality").collect()]
        single = [r["text"] for r in spark.read.parquet(f"{tmp_path}/1-near_duplicates").collect()]
        assert sorted(set(judged) - {None, "", "   \n\t "}) == sorted(t for t in single if t and t.split())
