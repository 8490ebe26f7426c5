"""The operators and their queries against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import os
import time
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import components, html_extract, media, mixing, packing, quality, tokens, toxicity, warc
from lexiloom.llm import queries as q

D = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def crc(doc):
    return zlib.crc32(str(doc).encode())


@tables
def test_op1_query(spark):
    """Every column from the texts; the fingerprint by a plain Fourier sum over frames."""
    frame, hop, per_frame, reach, fan = 128, 64, 3, 4, 3
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(frame), np.arange(frame // 2 + 1)) / frame)

    def fingerprint(payload):
        x = np.frombuffer(payload, np.uint8).astype(float) - 128
        n = max(1, 1 + -(-(len(x) - frame) // hop))
        x = np.concatenate([x, np.zeros(max(0, (n - 1) * hop + frame - len(x)))])
        peaks = []
        for t in range(n):
            mag = np.abs((x[t * hop : t * hop + frame] * window) @ basis)
            top = [(mag[k], k) for k in range(1, len(mag) - 1) if mag[k] > mag[k - 1] and mag[k] >= mag[k + 1] and mag[k] > 1e-3 * frame]
            peaks += sorted((t, k) for _, k in sorted(top, key=lambda p: -p[0])[:per_frame])
        pairs = []
        for i, (t, k) in enumerate(peaks):
            later = [p for p in peaks[i + 1 :] if p[0] > t][:fan]
            pairs += [(t, (k << 24) | (m << 8) | (u - t)) for u, m in later if u - t <= reach]
        return sorted(pairs)

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = q.op1_media_columns(spark, D).collect()
    made = {r["doc_id"]: r for r in media.media_columns(spark.read.parquet(f"{D}/documents.parquet").filter("length(text) < 3000")).collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        raw = docs[r["doc_id"]]
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        if r["doc_id"] in made:
            m = bytes(made[r["doc_id"]]["media"])
            assert r["media_bytes"] == len(m) and r["media_sha256"] == hashlib.sha256(m).hexdigest()
            with wave.open(BytesIO(m)) as w:
                assert w.readframes(w.getnframes()) == payload
    some = [d for d in made if d % 7 == 0]
    assert some
    agree = [sorted(zip(made[d]["times"], made[d]["codes"])) == fingerprint(bytes(made[d]["payload"])) for d in some]
    assert np.mean(agree) >= 0.9  # the operator works in single precision: near ties may fall the other way


@tables
def test_op5_and_op8_queries(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in docs.items()}
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op5_token_counts(spark, D).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert got == {d: (len(x.encode()), len(ids[d]), len(ids[d]) > 2048) for d, x in docs.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in q.op8_packing(spark, D).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, own in ids.items():
        want, at = np.array([*own, 2], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * sum(len(x) + 1 for x in ids.values())


def test_long_words():
    from tokenizers import Tokenizer

    r = np.random.default_rng(5)
    t, w = Tokenizer.from_file(tokens.default_path()), tokens.WordTokens(tokens.default_path())
    for word in ("".join("abcdefghijklmnopqrstuvwxyz"[k] for k in r.integers(0, 26, 120_000)), "ß" * 2000, "йцукен" * 300, "日本語" * 300, "'" * 999 + "re"):
        table = w.text_deltas(word)
        assert len(table) == len(word) and int(np.frombuffer(table, np.int8).sum()) == len(t.encode(word, add_special_tokens=False).ids)
    short = "xqzv" * 15
    table = w.text_deltas(short)
    assert [tokens.tokens_at(table, k) for k in range(61)] == [len(t.encode(short[:k], add_special_tokens=False).ids) for k in range(61)]
    assert w.held_bytes < w.LIMIT


def test_tables_start_anew():
    """Tables that are full at every word give what roomy ones give."""
    r = np.random.default_rng(8)
    texts = [" ".join("".join("etaoin"[k] for k in r.integers(0, 6, int(n))) for n in r.integers(1, 30, 40)) for _ in range(30)]
    roomy, tight = (tokens.WordTokens(tokens.default_path()) for _ in range(2))
    tight.LIMIT, tight.PAIRS = 500, 3
    assert [tight.text_deltas(t) for t in texts] == [roomy.text_deltas(t) for t in texts] and len(tight.pairs) <= 4
    few, many = (tokens.IdTokens(tokens.default_path()) for _ in range(2))
    few.LIMIT = 300
    assert [few.text_ids(t) for t in texts] == [many.text_ids(t) for t in texts]


def test_frequent_words_stay():
    """A word of every text is worked out once, however often rare ones fill the tables."""
    r = np.random.default_rng(9)
    w, asked = tokens.WordTokens(tokens.default_path()), collections.Counter()
    work = w.word_deltas
    w.word_deltas = lambda word: asked.update([word]) or work(word)
    w.LIMIT = 200_000
    for _ in range(400):
        w.text_deltas("common " + " ".join("".join("etaoin"[k] for k in r.integers(0, 6, 12)) for _ in range(20)))
    assert sum(asked.values()) > 8000 and asked["common"] == 1


def test_ids_of_words():
    """Ids of texts that normalise to special strings or change when normalised again; the library gets a new word once."""
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokens.default_path()), tokens.IdTokens(tokens.default_path())
    tight = tokens.IdTokens(tokens.default_path())
    tight.LIMIT = 500
    for text in ("a <|ENDOFTEXT|> b", "<|StartOfText|>", "x<|endoftext|>y <|EndOfText|>", "\u038f\u0345 o\u038f\u0345", "don't 've 're. \t", "\u0130A\u03a3"):
        want = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.text_ids(text) == want and tight.text_ids(text) == want

    class Library:
        asked: list = []

        def encode_batch_fast(self, texts, **kw):
            self.asked += " ".join(texts).split()
            return t.encode_batch_fast(texts, **kw)

    own.library = Library()
    text = "qzxv, (qzxv) qzxv. wvvk: qzxv"
    assert own.text_ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    own.text_ids("wvvk; wvvk! qzxv?")
    assert collections.Counter(Library.asked)["qzxv"] == collections.Counter(Library.asked)["wvvk"] == 1
    assert not any("qzxv" in w and w != "qzxv" for w in Library.asked)


def test_fitting_prefix(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    texts = [(1, "plain words in a row, with marks."), (2, ""), (3, None)]
    rows = tokens.fitting_prefix(tokens.prefix_table(spark.createDataFrame(texts, "doc_id long, text string")), 4).collect()
    got = {r["doc_id"]: r["fit_chars"] for r in rows}
    counts = [len(t.encode(texts[0][1][:k], add_special_tokens=False).ids) for k in range(len(texts[0][1]) + 1)]
    assert got == {1: max(k for k, c in enumerate(counts) if c <= 4), 2: 0, 3: 0}


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by pouring again and again, for sources in order."""
    total, target, open_ = share * sum(sizes.values()), {}, dict(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            del open_[s]
    return target


@tables
def test_op4_query(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    got = q.op4_source_mixing(spark, D).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = water(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    blocks = mixing.mixture_blocks(docs, shard_blocks=16).collect()
    by_doc = collections.Counter()
    for r in blocks:
        by_doc[r["doc_id"]] += r["n_words"]
    assert all(by_doc[r["doc_id"]] == r["taken"] for r in got)


def test_mixture_shards(spark):
    """Counts by shard and source vary as draws do, add up to the slots, and each block is taken once in an epoch."""
    rows = [(i, " ".join(["w"] * 64), f"s{i % 3}") for i in range(1500)]
    m = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), (5, 2, 1), 1.5, 2.0, 16, 64, 17)
    slots = m.slots().collect()
    need = {r["number"]: (r["slots"], r["n_blocks"]) for r in m.sources.collect()}
    assert {k: v[0] for k, v in need.items()} == dict(collections.Counter(r["number"] for r in slots))
    seen = collections.Counter((r["number"], r["epoch"], r["block"]) for r in slots)
    assert max(seen.values()) == 1 and all(0 <= b < need[n][1] for n, _, b in seen)
    counts = collections.Counter((r["shard"], r["number"]) for r in slots)
    n_shards, total = len({s for s, _ in counts}), len(slots)
    for number, (k, _) in need.items():
        p, own = k / total, np.array([counts[s, number] for s in range(n_shards)])
        assert 0.4 * 64 * p * (1 - p) < own.var() < 2.5 * 64 * p * (1 - p)
    assert len({(r["shard"], r["place"]) for r in slots}) == total
    n = F.lit(97)
    perm = spark.range(97).select(mixing.permuted(F.col("id"), n, F.lit(3)).alias("x")).select("x", mixing.permuted(F.col("x"), n, F.lit(3), inverse=True).alias("y"))
    assert sorted(r["x"] for r in perm.collect()) == list(range(97)) and [r["y"] for r in perm.collect()] == list(range(97))


def test_mixture_alike_rows(spark):
    rows = [(1, "a b c d", "s")] * 3 + [(2, "e f", "s"), (3, "g h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = sum(r["taken"] for r in mixing.mixture(docs).collect())
    assert taken == sum(len(r["text"].split()) for r in mixing.apply_mixture(docs).collect()) > 0


@tables
def test_op6_and_op7_scores(spark):
    """Scores lie in 0 .. 1, equal texts have equal ones, and rows that taught nothing are told apart."""
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for query, name, modulus, rest, least in ((q.op6_toxicity, "toxic", 5, 0, 0.75), (q.op7_quality_classifier, "quality", 3, 1, 0.85)):
        got = query(spark, D).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(text)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (crc(r["doc_id"]) % modulus == rest) for r in got)
        same = collections.defaultdict(set)
        for r in got:
            same[text[r["doc_id"]]].add(r["score"])
        assert all(len(s) == 1 for s in same.values())
        right = [r["predicted"] == labels[r["doc_id"]][name] for r in got if r["held_out"] and r["doc_id"] in labels and labels[r["doc_id"]][name] is not None]
        assert len(right) > 5 and np.mean(right) >= least


def test_discriminant_is_exact():
    r = np.random.default_rng(6)
    n = quality.N
    low = np.tril(r.standard_normal((n, n))) + 5 * np.eye(n)
    b = r.standard_normal((n, 7))
    assert np.allclose(low @ quality.forward_solve(low, b), b)
    means, covs = r.standard_normal((2, n)), [x @ x.T + np.eye(n) for x in r.standard_normal((2, n, n))]
    factors = np.array([np.linalg.cholesky(c) for c in covs])
    d = quality.Discriminant(np.zeros(n), np.ones(n), means, factors, np.array([2 * np.log(np.diag(f)).sum() for f in factors]), 0.3, 1.0)
    x = r.standard_normal((20, n))
    log = [[-0.5 * (v - m) @ np.linalg.inv(c) @ (v - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(means, covs)] for v in x]
    assert np.allclose(d.scores(x), [1 / (1 + np.exp(-np.clip(b - a + 0.3, -40, 40))) for a, b in log])


def test_levenshtein_brute_force():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    r = np.random.default_rng(7)
    word = lambda n: "".join("abc"[k] for k in r.integers(0, 3, n))
    terms = sorted({word(int(n)) for n in r.integers(5, 8, 12)})
    t = toxicity.Trie([(x, False) for x in terms])
    for _ in range(400):
        w = word(int(r.integers(3, 9)))
        least = min((edits(w, x), i) for i, x in enumerate(terms))
        got = t.match(w)
        assert got == (least if least[0] <= 1 else None)
        assert got is None or w in t.possible({w})


def test_context_scores():
    lex = toxicity.Lexicon([("vermin", False)], [(4.0, 3.0)])
    plain, quoted, told, you = (lex.evidence(x) for x in ("they are vermin here", 'it reads "vermin" on the wall', "she said vermin loudly", "you are vermin"))
    assert quoted < plain < you and told < plain and lex.evidence("these vermim here") == 3.0 and lex.evidence("") == 0.0 == lex.evidence(None)


P = "It was a long day, and nobody knew what would happen; still, they went on. "


@pytest.mark.parametrize("box", ["<article>{}</article>", "<div class='x7'>{}</div>", "<section id='k9'><div>{}</div></section>", "<main><div class='body'>{}</div></main>"])
def test_main_text_by_ratios(box):
    inner = f"<h1>Big title</h1><p>{P * 3}</p><ul><li>first thing<li>second one</ul><p>{P * 4}"
    want = " ".join(["Big title", (P * 3).strip(), "first thing second one", (P * 4).strip()])
    around = "<div class='q1'><a href='/a'>Home</a> <a href='/b'>About us</a></div>"
    page = f"<html><head><title>t</title></head><body>{around}{box.format(inner)}<footer>All rights reserved, of course. Really.</footer><form>Your name, please.</form></body></html>"
    assert html_extract.main_text(page) == want
    assert len(html_extract.main_text(page, 0.0)) > len(want) and html_extract.main_text(page, 1e9) == ""


def test_main_text_linear():
    def took(page):
        t = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - t

    for make in (lambda n: "<div>" * n + "x", lambda n: "<a " * n, lambda n: "<p>" + "<div>" * n + "</x>" * n, lambda n: "<a b=\"" * n + ">", lambda n: "<!-- " * n, lambda n: "<script>" * n, lambda n: "<ul>" + "<div>" * 50 + "<li>a" * n):
        took(make(2000))
        assert took(make(40_000)) < 60 * max(took(make(4000)), 0.004)


def test_salvage_inside_a_member():
    good = [warc.record(i, "u", b"payload %d" % i * 50, None, False) for i in range(5)]
    bad = bytearray(good[1])
    bad[-60] ^= 1
    data = warc.gzip_member(good[0] + bytes(bad) + good[2]) + warc.gzip_member(good[3]) + warc.gzip_member(good[4])[:-5]
    records, gaps = warc.salvage(data)
    assert [warc._urn(r["warc-record-id"]) for r in records] == [0, 2, 3, 4]
    assert gaps[0][1:] == (len(bad), "payload digest (inside a member)") and gaps[1][2] == "member end"


def test_op10_equal_payloads(spark, tmp_path):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(60)] + [(60, "u", ""), (61, "u", None)]
    os.makedirs(tmp_path, exist_ok=True)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_digest"]) for r in q.op10_warc(spark, str(tmp_path)).collect()}
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i, largest.get(h or "", -1))
    for i, _, h in rows:
        first = largest[h or ""]
        assert got[i] == (("response", None) if i == first else ("revisit", first)) + (base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 4)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@tables
def test_pipeline(spark, tmp_path):
    """Whole run over odd rows: stages keep columns, no document appears that a stage before let go, and pieces are whole."""
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(150)
    odd = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "", None, None, 0), (None, "no id", "en", "s", 5)], docs.schema)
    docs = docs.union(odd).union(docs.limit(5)).withColumn("size", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    now, before = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids = {r[0] for r in now.select("doc_id").collect()}
        assert before is None or ids <= before
        if name.startswith("MinHash"):
            assert now.filter("doc_id is not null").count() == len(ids - {None})
        before = ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    want = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in now.select("text").collect())
    assert pieces.agg(F.sum("length")).first()[0] == want
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == want


def test_packing_plan():
    h = np.zeros(8, int)
    h[[2, 4, 7]] = 10, 10, 3
    plan = packing.solve(h, 3)
    used = np.zeros(8, int)
    for p, times in plan:
        assert sum(p) == 8 and times > 0
        for b in p:
            used[b - 1] += times
    assert (used <= h).all() and used.sum() >= 20
