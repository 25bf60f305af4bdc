"""Operators 1, 4, 6, 9 and 10 against brute force, round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from glossa.llm import bpe, pii, ppm, queries, resample, textkit, toxicity
from llm_fixtures import clashing_docs, no_docs, odd_docs, odd_rows  # noqa: F401  (fixtures)

SF, SF_SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- shared kernel -----------------------------------------------------------------------------

def test_word_hashes_follow_the_word_rule():
    texts = ["Ab cd\tEF", "", "  x  ", "ab CD ef", "ä ß y"]
    buf, offs = textkit.text_buffer(pa.array(texts))
    h, n = textkit.word_hashes(buf, offs)
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    assert list(n) == [len(w) for w in words]
    seen = {}
    for w, x in zip([w for ws in words for w in ws], h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_text_hashes_equal_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(40000))
    whole = textkit.word_hashes(*textkit.text_buffer(pa.array([text])))[0]
    monkeypatch.setattr(textkit, "SLICE_BYTES", 1000)
    assert (textkit.word_hashes(*textkit.text_buffer(pa.array([text])))[0] == whole).all()


# ---- operator 1 --------------------------------------------------------------------------------

def _brute_bits(texts_by_lang, order, text):
    """PPM code length by dictionaries, byte by byte."""
    out = {}
    low = {lang: [t.encode().lower() if t.isascii() else bytes(textkit.LOWER[np.frombuffer(t.encode(), np.uint8)])
                  for t in ts] for lang, ts in texts_by_lang.items()}
    b = bytes(textkit.LOWER[np.frombuffer(text.encode(), np.uint8)])
    for lang, ts in low.items():
        count = {}
        for t in ts:
            for i in range(len(t)):
                for o in range(min(order, i) + 1):
                    c = count.setdefault(t[i - o:i], {})
                    c[t[i]] = c.get(t[i], 0) + 1
        bits = 0.0
        for i in range(len(b)):
            for o in range(min(order, i), -1, -1):
                c = count.get(b[i - o:i])
                if c is None:
                    if o == 0:
                        bits += 8
                    continue
                n, d = sum(c.values()), len(c)
                if b[i] in c:
                    bits -= np.log2(c[b[i]] / (n + d))
                    break
                bits -= np.log2(d / (n + d))
                if o == 0:
                    bits += 8
        out[lang] = bits
    return out


def test_ppm_code_lengths_equal_brute_force(spark):
    train = {"xx": ["The cat sat.", "a hat, the mat"], "yy": ["der hund lief", "Über das Feld"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, ts in train.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm.train(docs, order=3, docs_per_lang=100)
    texts = ["the hund sat", "Q!", "über", "", "feld feld", "z" * 70000]
    buf, offs = textkit.text_buffer(pa.array(texts))
    got = ppm.code_lengths(model, buf, offs)
    for row, text in zip(got, texts):
        want = _brute_bits(train, 3, text)
        assert row == pytest.approx([want[x] for x in model.langs], rel=1e-4, abs=1e-3)


def test_language_query_held_out_accuracy(spark):
    got = queries.op1_ppm_language(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index])
    assert (got["held_out"].to_numpy() == held).all() and got["score"].between(0, 1).all()
    right = got["lang_pred"] == docs["lang"].reindex(got.index)
    assert len(got) == len(docs) and right[held].mean() > 0.98


def test_language_sample_takes_whole_texts_and_bounds(spark, monkeypatch):
    step = textkit.SLICE_BYTES // 4
    long = "ab" * step + "zq" * 50  # several slices; its last bytes count as well
    docs = spark.createDataFrame([(1, long, "xx"), (2, "short text", "xx"), (2, "short text", "xx"), (3, "mot", "yy")],
                                 "doc_id long, text string, lang string")
    counts = {(r.lang, r.width, r.gram): r.n for r in ppm.count_ngrams(docs.filter("doc_id = 1"), 2).collect()}
    raw = long.encode()
    for width in (1, 2, 3):
        want = Counter(raw[i:i + width] for i in range(len(raw) - width + 1))
        assert {g: n for (_, w, g), n in counts.items() if w == width} == \
            {int.from_bytes(g, "big"): n for g, n in want.items()}
    assert sorted(r.text[:9] for r in ppm.sample_per_lang(docs, 600).collect()) == ["ababababa", "mot", "short tex"]
    many = spark.createDataFrame([(i, f"text number {i} of it", f"l{i % 500:03d}") for i in range(2000)],
                                 "doc_id long, text string, lang string")
    monkeypatch.setattr(ppm, "MAX_LANGS", 200)
    monkeypatch.setattr(ppm, "SAMPLE_BYTES", 200 * 40)
    got = Counter(r.lang for r in ppm.sample_per_lang(many, 600).collect())
    assert set(got) == {f"l{i:03d}" for i in range(200)}  # ties by name; whole texts until 40 bytes are reached
    assert set(got.values()) == {2, 3} or set(got.values()) == {2}


def test_language_odd_cases(spark, clashing_docs, no_docs, odd_rows):
    model = ppm.train(clashing_docs)
    got = ppm.predict(clashing_docs, model, ppm.held_out(4, 2)).toPandas()
    assert len(got) == len(odd_rows)
    none = got[got["doc_id"].isin([4, 5, 6, 10])]
    assert (none["lang_pred"] == "und").all() and (none["score"] == 0).all()
    assert not got[got["doc_id"].isna()]["held_out"].any()
    assert ppm.predict(no_docs, model, ppm.held_out(4, 2)).count() == 0
    empty = ppm.train(no_docs)
    assert {r.lang_pred for r in ppm.predict(clashing_docs, empty, ppm.held_out(4, 2)).collect()} == {"und"}
    kept = ppm.keep_language(clashing_docs, model)
    assert kept.columns == clashing_docs.columns and {1, 2, 3, 7, 8, 11, 12} <= {r.doc_id for r in kept.collect()}
    assert not {4, 5, 6, 10} & {r.doc_id for r in kept.collect()}


# ---- operator 4 --------------------------------------------------------------------------------

def _encoding():
    ranks = {}
    with open(RANKS, "rb") as f:
        import base64
        for line in f:
            a, b = line.split()
            ranks[base64.b64decode(a)] = int(b)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_also_for_split_texts(spark, clashing_docs, monkeypatch):
    enc = _encoding()
    got = bpe.round_trip_digests(clashing_docs, RANKS, public_tokenizers.PATTERN).toPandas()
    texts = clashing_docs.select("doc_id", "text").toPandas()
    want = []
    for i, t in zip(texts["doc_id"], texts["text"]):
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(want) == sorted((str(a), *b) for a, *b in got.itertuples(index=False))
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    rng = np.random.default_rng(0)
    alphabet = list("ab cd\n\t  'sé1 2.,!?—  \x85x")
    for n in (49, 51, 500, 3000):
        text = "".join(rng.choice(alphabet, n))
        assert "".join(bpe.safe_pieces(text, 50)) == text
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)


def test_bpe_ids_round_trip_and_empty_table(spark, clashing_docs, no_docs):
    ids = bpe.with_tokens(clashing_docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_tokens(ids, RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in back.collect())
    assert bpe.with_tokens(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- operator 6 --------------------------------------------------------------------------------

def test_resampling_selects_the_exact_top_k(spark, odd_docs):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = resample.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    for share in (0.0, 0.3, 1.0):
        keys, cut = resample.resample(docs, model, share)
        pdf = keys.toPandas()
        ranked = pdf[pdf["n_grams"] > 0].sort_values(["gumbel_key", "doc_id"], ascending=[False, True])
        k = int(round(share * len(ranked)))
        assert set(pdf[pdf["selected"]]["doc_id"]) == set(ranked["doc_id"][:k])
        assert {r.doc_id for r in resample.select_rows(docs, model, cut).collect()} == set(ranked["doc_id"][:k])


def test_order_bits_and_radix_select(spark):
    x = np.array([-np.inf, -3.5, -0.0, 0.0, 1e-300, 2.0, 1e9, np.inf])
    bits = resample._order_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all()
    v = [int(a) for a in np.random.default_rng(1).integers(-2**62, 2**62, 300)] + [7, 7, 7]
    rows = spark.createDataFrame([(a,) for a in v], "v long")
    for k in (1, 2, 150, 303):
        for desc in (True, False):
            want = sorted(v, reverse=desc)
            got, before = resample.radix_select(rows, "v", k, desc)
            assert got == want[k - 1] and before == want.index(got)


def test_quality_rejects_junk_and_keeps_clean_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op6_importance_resampling(spark, SF).join(labels, "doc_id").toPandas()
    assert got[got["quality"] == 1]["selected"].mean() > 0.98
    assert got[got["quality"] == 0]["selected"].mean() < 0.1
    assert docs.count() == queries.op6_importance_resampling(spark, SF).count()


def test_quality_odd_cases(spark, clashing_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (3, 0), (4, None)], "doc_id long, quality int")
    model = resample.train(clashing_docs, labels)
    keys, cut = resample.resample(clashing_docs, model)
    pdf = keys.toPandas()
    assert len(pdf) == clashing_docs.count()
    assert not pdf[pdf["doc_id"].isin([4, 5])]["selected"].any() and pdf[pdf["doc_id"] == 1]["selected"].all()
    assert resample.select_rows(clashing_docs, model, cut).columns == clashing_docs.columns
    keys, cut = resample.resample(no_docs, resample.train(no_docs, labels.limit(0)))
    assert keys.count() == 0 and resample.select_rows(no_docs, model, cut).count() == 0


# ---- operator 9 --------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(3)
    alphabet = list("ab1234567890..@@+-  ()%_\né")
    fixed = ["a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3", "4111 1111 1111 1111", "+1 (938) 555-0822 x",
             "a.b@c", "@x.y", "a@@b.c", "00000.1.2.3", "4111-1111-1111-1112", "+12", "1" * 5000]
    for text in fixed + ["".join(rng.choice(alphabet, rng.integers(1, 80))) for _ in range(4000)]:
        assert pii.base_spans(text)[0] == _brute_base(text), text


def test_skip_chain_marks_repeats_of_known_entities(spark):
    known = "call +1 (938) 555-0822 now"
    rows = [(i, f"{known} word{i}") for i in range(40)]
    rows += [(100, known + " or 555-0822 later."), (101, "or 555-0822 later, plain text"), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs, pii.train(docs)).collect()}
    assert got[100].spans == "phone:5:22,phone:30:38" and got[100].n_phone == 1
    assert got[100].base_sha256 == hashlib.sha256(b"phone:5:22").hexdigest()
    assert got[101].spans == "" and got[102].spans == "" and got[103].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in pii.redact(docs.withColumn("n_chars", F.lit(1).cast("long")), pii.train(docs)).collect()}
    assert masked[100].text == "call [PHONE] now or [PHONE] later." and masked[102].text is None
    assert masked[100].n_chars == len(masked[100].text)


def test_name_part_of_an_email(spark):
    rows = [(i, f"mail jane.smith{i}@mail.org or jane.smith{i}@mail.org, room {i}") for i in range(40)]
    rows += [(100, "ask jane.smith@mail.org, then Jane.Smith, or info@mail.org for info"), (101, "jane.smith alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs, pii.train(docs)).collect()}
    assert got[100].spans == "email:4:23,email:30:40,email:45:58" and got[100].n_email == 2
    assert got[101].spans == ""


def test_token_shapes_use_the_whole_token():
    assert pii.shape_bucket("a1-" * 40) != pii.shape_bucket("a1-" * 40 + "x")


def test_message_passing_equals_enumeration():
    rng = np.random.default_rng(2)
    model = {"unary": rng.normal(size=(pii.SHAPES, 5)), "chain": rng.normal(size=(5, 5)), "skip": rng.normal(size=(5, 5))}
    g = pii.Graph.__new__(pii.Graph)
    g.at, g.label, g.shape = [(0, 1)] * 4, [-1, 2, -1, -1], [1, 2, 3, 4]
    g.chain, g.skip = [(0, 1), (1, 2)], [(1, 3)]  # a tree: message passing is exact
    p = np.zeros((5,) * 4)
    for y in np.ndindex(*p.shape):
        e = sum(model["unary"][s, y[i]] for i, s in enumerate(g.shape))
        e += sum(model["chain"][y[i], y[j]] for i, j in g.chain) + sum(model["skip"][y[i], y[j]] for i, j in g.skip)
        p[y] = np.exp(e) if y[1] == 2 else 0.0
    p /= p.sum()
    want = np.array([p.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
    assert pii.propagate(g, model, rounds=200) == pytest.approx(want, abs=1e-4)


def test_pii_query_and_odd_cases(spark, clashing_docs, no_docs):
    got = queries.op9_skip_chain_pii(spark, SF).toPandas().set_index("doc_id")
    for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False):
        base = _brute_base(t)
        assert got.loc[i, "base_sha256"] == hashlib.sha256(pii.render(base).encode()).hexdigest()
        assert set(pii.render(base).split(",")) <= set(got.loc[i, "spans"].split(",")) | {""}
    model = pii.train(clashing_docs)
    assert pii.find_pii(clashing_docs, model).count() == clashing_docs.count()
    assert pii.find_pii(no_docs, pii.train(no_docs)).count() == 0 and pii.redact(no_docs, model).count() == 0


# ---- operator 10 -------------------------------------------------------------------------------

def _brute_kernel(a, b):
    def phi(word):
        out = {}
        c = toxicity._CLASS[textkit.LOWER[np.frombuffer(word.encode(), np.uint8)]]
        for i in range(len(c)):
            for g, h in toxicity.PATTERNS:
                if i + g + h + 2 < len(c):
                    u = (c[i], c[i + g + 1], c[i + g + h + 2])
                    if all(u):
                        out[u] = out.get(u, 0) + toxicity.DECAY ** (g + h)
        return out
    x, y = phi(a), phi(b)
    dot = sum(v * y.get(u, 0) for u, v in x.items())
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return dot / norm if norm else 0.0


def _units(*words):
    return toxicity._bags([" ".join(words)])[0]


def test_kernel_equals_subsequence_enumeration():
    words = ["pathetic", "p.a.t.h.e.t.i.c", "pathology", "scum", "sccuum", "idiot", "i-d-i-o-t", "zebra"]
    got = toxicity.Landmarks(_units(*words)).kernel(_units(*words))
    want = [[_brute_kernel(a, b) for b in words] for a in words]
    assert got == pytest.approx(np.array(want), abs=1e-5)
    assert got[0, 1] > 0.6 > got[0, 2] and got[5, 6] > 0.5 > got[5, 7]


def test_units_of_spaced_out_and_long_words():
    units, rows = toxicity._bags(["an i d i o t here", "x" * 100, "", "a b"])
    text = [bytes(u).rstrip(b"\0").decode() for u in units]
    assert "idiot" in text and rows[text.index("idiot")] == 0
    assert sum(r == 1 for r in rows) > 3 and 2 not in rows and "ab" not in text


def test_toxicity_query_held_out(spark):
    got = queries.op10_string_kernel_toxicity(spark, SF).toPandas().set_index("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index])
    assert (got["held_out"].to_numpy() == held).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all() and got["score"].between(0, 1).all()
    y = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    both = got[held].join(y, how="inner")
    hit = both["predicted"] == 1
    assert both[hit]["toxic"].mean() > 0.8 and both[both["toxic"] == 1]["predicted"].mean() > 0.6


def test_toxicity_tolerates_inserted_characters():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeiourstnl"), rng.integers(3, 9))) for _ in range(400)]

    def text(*bad):
        w = list(rng.choice(words, 40))
        for b in bad:
            w.insert(int(rng.integers(len(w))), b)
        return " ".join(w)
    machine = toxicity.fit([text("gromwick", "blaphund") for _ in range(60)], [text() for _ in range(200)])
    m = toxicity.text_margins(machine, [text(), text("gromwick"), text("g.r.o.m.w.i.c.k"), text("blapphund"), "", "  "])
    assert machine.score(m[1:4]).min() > 0.5 > machine.score(m[:1])[0]
    assert machine.score(m[4]) == machine.score(m[5]) <= machine.score(m[0])


def test_toxicity_odd_cases(spark, clashing_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    held = ppm.held_out(3, 1)
    for lab in (labels, labels.limit(0)):
        machine = toxicity.train(clashing_docs, lab)
        assert toxicity.score(clashing_docs, machine, held).count() == clashing_docs.count()
        assert toxicity.score(no_docs, machine, held).count() == 0
    got = toxicity.score(clashing_docs, machine, held).toPandas()
    assert (got["score"] < 1e-9).all()


def test_toxicity_sample_holds_whole_texts_of_distinct_ids(spark, monkeypatch):
    late = "word " * 15_000 + "gromwick"
    docs = spark.createDataFrame([(1, late, 0), (2, "a fine text", 1), (3, "another text", 1), (4, None, 1), (2, "a fine text", 5)],
                                 "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    labels = labels.unionAll(labels.filter("doc_id = 2").join(spark.range(100_000), how="cross").select("doc_id", "toxic"))

    def sample():
        return sorted(tuple(r) for r in toxicity.labelled_sample(docs, labels, 10, 10).collect())
    assert sample() == [("a fine text", 0), ("another text", 0), (late, 1)]
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 5)  # the text that passes the bound is the last one, and whole
    got = sample()
    assert len(got) == 2 and got[0][0] in ("a fine text", "another text") and got[1] == (late, 1)
    assert toxicity.labelled_sample(docs, labels.limit(0), 10, 10).count() == 0
