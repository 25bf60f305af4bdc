"""Operators 11, 12 and 13 against brute force and planted cases."""

import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import lineblocks, merkle, negatives, queries
from llm_fixtures import clashing_docs, no_docs, odd_docs, odd_rows  # noqa: F401  (fixtures)
from oracle import compare, duck

SF, SF_SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


# ---- operator 11 -------------------------------------------------------------------------------

def brute_negatives(rows, anchor, moved, positives=5, negatives=3):
    """All pairs in Python integers."""
    seen = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        seen[vec_id, moved(vec_id, label), tuple(math.floor(256 * c) for c in x)] = None
    out = []
    for a, la, xa in seen:
        if not anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(xa, x)), v, l) for v, l, x in seen if v != a and len(x) == len(xa)]
        best = sorted(s for s in scored if s[2] == la)[:positives]
        for ps, p, _ in best:
            fit = sorted(s for s in scored if s[2] != la and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:negatives]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


NEG_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
VEC_SCHEMA = "vec_id long, embedding array<double>, label int"


def mined(df):
    return sorted(tuple(r) for r in df.select(*NEG_COLUMNS).collect())


def moved(vec_id, label):
    return (label + 1) % 10 if vec_id % 7 == 0 else label


def test_negatives_query_equals_sql_and_brute_force(spark):
    got = queries.op11_slot_negatives(spark, SF)
    ok, msg = compare(got, duck(SF), queries.ORACLE_SQL["op11_slot_negatives"])
    assert ok, msg
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert mined(got) == brute_negatives(rows, lambda v: v % 50 == 0, moved)


def random_vectors(seed, n, labels=3, dim=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dim)
    return [(int(k), [float(c) for c in np.round((base + rng.normal(size=dim)) * 2) / 8], int(rng.integers(labels)))
            for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_negatives_in_many_blocks_slices_and_ties(spark, seed, monkeypatch):
    rows = random_vectors(seed, 400)
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(200)]  # a third are copies of one vector: ties by id
    rows += rows[:50]  # repeated rows
    monkeypatch.setattr(negatives, "SLICE_SCORES", 500)
    df = spark.createDataFrame(rows, VEC_SCHEMA).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, F.col("label"), block_bytes=600)
    assert mined(got) == brute_negatives(rows, lambda v: v % 20 == 0, lambda v, l: l)


def test_negatives_of_odd_vectors(spark):
    rows = random_vectors(7, 60) + [
        (0, None, 1), (50, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (100, [float("nan")] * 6, 1), (150, [math.inf] * 6, 2),
        (200, [1.0] * 6, None), (None, [1.0] * 6, 1), (250, [], 1), (251, [], 1), (252, [], 2), (300, [2.0, 1.0], 1),
        (301, [1.0, 1.0], 1), (302, [1.0, 0.4], 2), (350, [0.0] * 6, 0), (400, [-1.0] * 6, 2), (450, [1.0] * 6, 1),
        (450, [0.5] * 6, 1), (450, [1.0] * 6, 1)]
    df = spark.createDataFrame(rows, VEC_SCHEMA)
    for frame in (df, df.select("*", *[F.lit("x").alias(c) for c in ("number", "slot", "score", "rank", "x", "dim", "ps")])):
        assert mined(negatives.mine(frame)) == brute_negatives(rows, lambda v: v % 50 == 0, moved)
    assert mined(negatives.mine(df.limit(0))) == []
    assert mined(negatives.mine(df.filter("vec_id = 1"))) == []


@pytest.mark.parametrize("scale", (2.0**20, 2.0**40))
def test_negatives_of_large_components_are_exact(spark, scale):
    rows = [(k, [c * scale for c in x], l) for k, x, l in random_vectors(3, 80)]
    rows += [(k + 500, [c * scale + (k % 3) / 256 for c in x], l) for k, x, l in random_vectors(3, 80)]
    got = mined(negatives.hard_negatives(spark.createDataFrame(rows, VEC_SCHEMA), F.col("vec_id") % 20 == 0, F.col("label")))
    want = brute_negatives(rows, lambda v: v % 20 == 0, lambda v, l: l)
    top = 2**63 - 1
    assert got == sorted((*r[:4], min(r[4], top), min(r[5], top)) for r in want)


# ---- operator 12 -------------------------------------------------------------------------------

def brute_manifest(rows, tampered, fanout=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, text, lang, source, n_chars) rows."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc_id, text, lang, source, n_chars):
        return h(*map(enc, (doc_id, source, lang, n_chars, text)))

    def grow(nodes):
        """The levels of a tree from its leaves."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k:k + fanout]) for k in range(0, len(levels[-1]), fanout)])
        return levels

    def steps(levels, pos):
        for level in levels[:-1]:
            run = level[pos // fanout * fanout:pos // fanout * fanout + fanout]
            yield run[:pos % fanout], run[pos % fanout + 1:]
            pos //= fanout

    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append(grow([leaf(*r) for r in by_source[s]]))
    top = grow([t[-1][0] for t in trees]) if trees else []
    out = []
    for g, s in enumerate(names):
        for pos, r in enumerate(by_source[s]):
            path = [*steps(trees[g], pos), *steps(top, g)]
            folded = leaf(r[0], tampered(r), *r[2:])
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf(*r), trees[g][-1][0], top[-1][0], h(*[x for p in path for side in p for x in side]),
                        folded, folded == top[-1][0]))
    return sorted(out, key=str)


def cut(r):
    return r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[1].replace("\n", "")


def audited(docs, **options):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.audit(docs, merkle.without_line_feeds(), **options).select(*cols).collect()), key=str)


def test_manifest_query_equals_sql_and_brute_force(spark):
    ok, msg = compare(queries.op12_merkle_manifest(spark, SF), duck(SF), queries.ORACLE_SQL["op12_merkle_manifest"])
    assert ok, msg
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = audited(docs)
    assert got == brute_manifest([tuple(r) for r in docs.collect()], cut)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark, odd_docs, odd_rows, clashing_docs, no_docs):
    want = brute_manifest(odd_rows, cut)
    assert audited(odd_docs) == want
    names = [c for c in ("grp", "leaf", "seen", "subroot", "root", "path", "pos", "at", "salt", "s0") if c not in clashing_docs.columns]
    assert audited(clashing_docs.select("*", *[F.lit("x").alias(c) for c in names])) == want
    assert audited(no_docs) == []


@pytest.mark.parametrize("fanout", (2, 3, 5))
def test_manifest_of_hot_lone_and_many_sources(spark, fanout):
    rows = [(k, f"a\nb{k}", None, "hot" if k % 3 == 0 else f"s{k % 90}", k) for k in range(400)]
    rows += [(7, "same\n", "en", "copies", 1)] * 100 + [(5, "lone", "en", "é", 4), (None, "\n", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert audited(docs, fanout=fanout) == brute_manifest(rows, cut, fanout)
    one = docs.filter("source = 'é'")
    assert audited(one, fanout=fanout) == brute_manifest([rows[-2]], cut, fanout)


# ---- operator 13 -------------------------------------------------------------------------------

def page(body, head=""):
    return f'<!DOCTYPE html><html><head><title>T &amp; t</title>{head}</head><body>{body}</body></html>'


LONG = "A sentence of the article that is long enough to make the text surge, with more words after it."
PAGES = [
    # furniture by element, comments with markup inside, scripts with tags in strings
    (page("<nav><ul><li><a href=x>Home</a></li></ul></nav><!-- <p>no</p> --><article><h1>Head</h1><p>One<br>two</p>"
          "<script>var t='<p>x</p>';</script><p>Three &amp;amp; &lt;b&gt; &copy; &#233;</p></article><footer>f</footer>"),
     "Head\n\nOne two\n\nThree &amp; <b> © é"),
    # unclosed paragraphs and body, a broken b
    ("<body><div class='ad'>Buy</div><article><h1>H</h1><p><b>First.<br><p>Second  \n\t third.</p></article><footer>c",
     "H\n\nFirst.\n\nSecond third."),
    # furniture inside the article: advert, form, notice, reader comments, shares
    (page(f"<main><p>{LONG}</p><div class='ad-slot'>Ad</div><form><p>Mail us</p><input></form><p>Short.</p>"
          "<div class='cookie-notice'>We use cookies</div><aside><p>Side</p></aside>"
          "<section id='comments'><article class='comment'><p>First!</p></article></section></main>"), f"{LONG}\n\nShort."),
    # no marked article: the distribution alone
    (page(f"<div><a href=a>Home</a> <a href=b>News</a></div><div id=x><h2>Title</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>"
          "<div class='sidebar'>S</div><div><a href=c>Terms</a></div>"), f"Title\n\n{LONG}\n\nYes.\n\n{LONG}"),
    # quoted '>' in attributes, upper-case names, white space in tags, an unclosed furniture element before the article
    ("<BODY><DIV CLASS='sidebar' title='a > b'>Side<ARTICLE ><P title=\">\">In <EM>the</EM>re a<B>bc</B></P ></ARTICLE>"
     "<Footer>x</Footer>", "In there abc"),
    # '<' that begins no tag, a reference without semicolon, no-break spaces
    ("<article><p>1 < 2 &amp 3&nbsp;&nbsp;4</p></article>", "1 < 2 & 3 4"),
    # a broken comment and a broken script end with the page
    ("<article><p>Kept</p><!-- <p>lost</p></article>", "Kept"),
    ("<article><p>Kept</p><script>var a = '</p>';", "Kept"),
    ("<article><p>Kept</p><p", "Kept"),
    ("plain text without tags", "plain text without tags"), ("", ""), (None, ""), ("<p></p>", ""), ("   ", ""),
    ("<article><p hidden>No</p><p style='display: none'>No</p><div role='navigation'>No</div><p>Yes</p></article>", "Yes"),
    ("<article><table><tr><td>a</td><td>b</td></tr></table><ul><li>c<li>d</ul><pre>e\n f</pre></article>",
     "a\n\nb\n\nc\n\nd\n\ne f"),
]


def test_pages_with_planted_furniture(spark):
    for source, want in PAGES:
        assert lineblocks.main_text(source) == want, source
    rows = [(None if k == 3 else k, None if k == 4 else f"u{k}", s) for k, (s, _) in enumerate(PAGES)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for frame in (df, df.select("*", *[F.lit("x").alias(c) for c in ("text", "n_chars", "line")])):
        got = sorted((tuple(r) for r in lineblocks.extract(frame).collect()), key=str)
        texts = [w for _, w in PAGES] + [PAGES[0][1]]
        assert got == sorted(((*r[:2], t, len(t)) for r, t in zip(rows, texts)), key=str)
    assert lineblocks.extract(df.limit(0)).collect() == []


def test_every_article_of_the_table_is_whole(spark):
    """The pages' articles, cut out by a pattern of their own, with tags removed and white space levelled."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[A-Za-z/!][^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = queries.op13_line_block_text(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_long_page_and_many_unclosed_elements():
    body = "".join(f"<div><p>Paragraph {k} of a long page, with enough words to matter." for k in range(20_000))
    assert lineblocks.main_text(f"<article>{body}").count("\n\n") == 19_999
    assert lineblocks.main_text("<" * 50_000 + "a") != ""
