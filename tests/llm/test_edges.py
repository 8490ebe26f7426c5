"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import embed_dedup, html_extract, media, mixing, near_dup, packing, quality, tokens, toxicity, warc

CLASH = ("_h", "_b", "_k", "_s", "a", "b", "rep", "node", "size", "target", "score", "x", "bucket", "part", "component", "text_", "_doc", "_kept", "_id", "y")
LONG = " ".join(f"word{i % 997} tail{i % 13}." for i in range(40_000))
SHORT = "one two three four five six seven eight nine ten"
TEXTS = [(0, None, None), (1, "", "s"), (2, SHORT, "s"), (3, SHORT, "s"), (3, SHORT, "s"), (4, "One\tTWO three", None), (5, LONG, "t"), (6, LONG + " end", "t"), (7, "ß ∑ naïve 𝒳 'RE you're", "s"), (None, "no id here at all", "s")]


def docs(spark, rows=TEXTS, clash=True):
    df = spark.createDataFrame([(a, b, "en", c, len(b or "")) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def labels(spark, n=400):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(n)] + [(None, 1, 1), (5, None, None), (2, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in ("_b", "x", "score")})


OPERATORS = {
    "media": lambda s, d: media.media_columns(d),
    "near_dup": lambda s, d: near_dup.near_duplicates(d),
    "keep_first": lambda s, d: near_dup.keep_first(d),
    "mixture": lambda s, d: mixing.mixture(d),
    "mixture_blocks": lambda s, d: mixing.mixture_blocks(d),
    "apply_mixture": lambda s, d: mixing.apply_mixture(d),
    "tokens": lambda s, d: tokens.prefix_table(d),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, labels(s)),
    "keep_civil": lambda s, d: toxicity.keep_civil(d, labels(s)),
    "quality": lambda s, d: quality.quality_scores(d, labels(s)),
    "keep_good": lambda s, d: quality.keep_good(d, labels(s)),
    "pack": lambda s, d: packing.pack(d),
}
PER_ROW = ("media", "near_dup", "mixture", "tokens", "toxicity", "quality")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, docs(spark)).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(t[0]) for t in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, docs(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("name", ("keep_first", "keep_civil", "keep_good", "apply_mixture"))
def test_stages_keep_columns(spark, name):
    d = docs(spark)
    assert OPERATORS[name](spark, d).columns == d.columns


def test_media_round_trip(spark):
    for r in media.media_columns(docs(spark, clash=False)).collect():
        want = next((t[1] or "").encode() for t in TEXTS if t[0] == r["doc_id"])
        assert r["n_bytes"] == len(want) and bytes(r["payload"]) == media.payload_of(want) == media.from_wav(bytes(r["media"]))
        assert len(r["payload"]) % 576 == 0 and len(r["payload"]) > 0 and len(r["times"]) == len(r["codes"])


def test_near_dup_results(spark):
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs(spark, clash=False)).collect()}
    assert got[0]["n_shingles"] == got[1]["n_shingles"] == 0 and got[0]["component_id"] == 0 and got[1]["component_id"] == 1
    assert got[2]["n_shingles"] == 6 and got[4]["n_shingles"] == 1
    assert got[3]["component_id"] == 2 and not got[3]["kept"] and got[6]["component_id"] == 5


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    w = tokens.WordTokens(tokens.default_path())
    for _, text, _ in TEXTS:
        table = w.text_deltas(text or "")
        assert int(np.frombuffer(table, np.int8).sum()) == len(t.encode(text or "", add_special_tokens=False).ids)
        if text and len(text) < 100 and text.isascii():
            for k in range(len(text) + 1):
                assert tokens.tokens_at(table, k) == len(t.encode(text[:k], add_special_tokens=False).ids)


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    rows = [x for x in TEXTS if x[0] is not None and x[0] != 3]
    got = packing.pack(docs(spark, rows, False)).collect()
    pieces: dict = {}
    sequences: dict = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, text, _ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_mixture_limits(spark):
    rows = mixing.mixture(docs(spark, clash=False)).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows) and sum(r["size"] for r in rows if r["doc_id"] in (0, 1)) == 0
    assert sorted(rows, key=str) == sorted(mixing.mixture(docs(spark, clash=False)).collect(), key=str)
    by: dict = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - target) <= 1 for (_, target), v in by.items())


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.25 * r.standard_normal(8)).tolist(), i % 3) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, None, 1), (302, [0.0] * 8, 1), (303, [float("nan")] * 8, 1), (304, rows[0][1], None), (305, [None] * 8, 1), (306, [1.0, 2.0], 1), (307, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("x", "_h", "rep", "a", "b", "mult", "component", "node")})
    got = {x["vec_id"]: x for x in embed_dedup.embedding_components(df).collect()}
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v, lab in ok:
        for j, u, lab2 in ok:
            if i != j and lab == lab2 and len(u) == len(v) and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.93:
                links[i].add(j)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), min(seen), i == min(seen)), i
    assert embed_dedup.embedding_components(df.limit(0)).collect() == []


PAGES = [
    (1, "u", "<html><body><nav><a>menu</a></nav><article><h1>Title &amp; more</h1><p>First  paragraph, long enough to count as text.<p>Second one, and it is about as long as the first.</article><footer>foot</footer></body></html>"),
    (2, "u", None), (3, "v", ""), (4, "v", "plain text only"), (5, None, "<p>unfinished <b"), (6, "w", "<article>" + "<p>again and again, it goes on.</p>" * 30_000 + "</article>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "_d", "_s", "refers_to", "n_chars")})


def test_html(spark):
    got = {r["page_id"]: r for r in html_extract.extract(pages(spark)).collect()}
    assert got[1]["text"] == "Title & more First paragraph, long enough to count as text. Second one, and it is about as long as the first."
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "plain text only"
    assert got[6]["n_chars"] == len(got[6]["text"]) == 30_000 * len("again and again, it goes on. ") - 1
    assert html_extract.extract(pages(spark).limit(0)).collect() == []


def test_warc_round_trip(spark):
    rows = PAGES + [(7, "u", PAGES[0][2]), (8, "z", None), (8, "z", None), (None, "n", "")]
    got = warc.read_archives(warc.write_archives(pages(spark, rows))).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
    for r in got:
        payload = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert ("1", "revisit", 7) in kinds and ("7", "response", None) in kinds and ("None", "revisit", 8) in kinds
    assert [k[1] for k in kinds if k[0] == "8"] == ["response", "revisit"]
    assert warc.read_archives(warc.write_archives(pages(spark).limit(0))).collect() == []


def test_warc_salvage():
    parts = [warc.gzip_member(warc.record(i, "u", b"payload %d" % i * 50, None, False)) for i in range(6)]
    data = parts[0] + b"junk" * 9 + parts[1] + parts[2][:-9] + b"\0" * 9 + parts[3][5:] + warc.record(4, "u", b"plain", None, False) + parts[5][:40]
    records, gaps = warc.salvage(data)
    # of the third member only the trailer is damaged: its record is whole by its own digest
    assert [warc._urn(r["warc-record-id"]) for r in records] == [0, 1, 2, 4]
    assert sum(g[1] for g in gaps) + len(parts[0]) + len(parts[1]) + len(warc.record(4, "u", b"plain", None, False)) == len(data)


def test_classifiers_without_labels(spark):
    none = labels(spark).limit(0)
    assert {r["score"] for r in quality.quality_scores(docs(spark), none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.toxicity_scores(docs(spark), none).collect()} == {0.0}


def test_levenshtein_trie():
    t = toxicity.Trie([("abcdef", False), ("stemx", True)])
    assert t.match("abcdef") == (0, 0) and t.match("abdef") == (1, 0) and t.match("abxdef") == (1, 0) and t.match("abccdef") == (1, 0)
    assert t.match("abdf") is None and t.match("stemxing") == (0, 1) and t.match("stexing") == (1, 1)
