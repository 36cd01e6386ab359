"""Each corpus operator against a brute-force version, and on nulls, empty tables, repeats and clashing names."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assayline.llm import bpe, catalog, decontaminate, exact, lines, quality, secret_scan, simhash, templates, toxicity, warc
from assayline.llm.links import smallest_reachable
from assayline.session import scratch_folder

P = pytest.importorskip("public_tokenizers")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

WORDS = "alpha beta gamma delta été rho tau sigma Omega".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


TEXTS = [
    None, "", " \n\t ", "one", "Two words", "two WORDS", "É é", "é É", prose(1, 40), prose(1, 40).upper(), prose(1, 40) + " end",
    prose(2, 2000), "x" * 5000, "a\x1cb c d", "<|endoftext|> tail", "line one is here\nline one is here\n\nline two is here", prose(3, 12),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 2}", i) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "again", 0), (None, "no id", "s", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, key long").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, key long")


def norm(text):
    return (text or "").translate(A_TO_Z)


# ---- byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.read_tokenizer(P.path("byte_bpe_50k.json"))


def test_bpe_equals_the_tokenizers_library(docs, tokenizer):
    theirs = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for row in bpe.encode(docs, tokenizer, "text", ("doc_id", "text")).collect():
        assert row["ids"] == theirs.encode(row["text"] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "a \n b", "<|endoftext|>", "x<|endoftext|> y", "\u0085 q　", "don't", "a" * 300, "0 ½ ²x"])
def test_bpe_edges(text, tokenizer):
    theirs = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    codec = bpe.codec_of(tokenizer)
    ids = np.frombuffer(codec.encode(text), "<u4")
    assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_decoding_of_any_tokens(spark, tokenizer):
    theirs = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(0, 50257, 12).tolist()) for i in range(100)] + [(100, []), (101, None)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    for row in bpe.decode(df, tokenizer, "ids", ("k", "ids")).collect():
        assert row["text"] == theirs.decode(row["ids"] or [], skip_special_tokens=False)


def test_bpe_round_trip(docs, nothing, tokenizer):
    for row in bpe.round_trip(docs, tokenizer, "text", ("text",), with_ids=True).collect():
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
        assert row["n_tokens"] == len(row["ids"])
        assert row["ids_sha256"] == hashlib.sha256(np.array(row["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(nothing, tokenizer).count() == 0


# ---- lines


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def edited(rng, text, n):
    for _ in range(n):
        i = int(rng.integers(0, len(text) + 1))
        text = text[:i] + ["", "q", "é"][rng.integers(0, 3)] + text[i + int(rng.integers(0, 2)) :]
    return text


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_edit_distance(spark, edits):
    rng = np.random.default_rng(edits)
    pairs = [(a := "".join(rng.choice(list("abé"), rng.integers(0, 20))), edited(rng, a, int(rng.integers(0, 4)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "x string, y string")
    for x, y, d in df.select("x", "y", lines.edit_distance(F.col("x"), F.col("y"), edits)).collect():
        assert d == distance(x, y) if distance(x, y) <= edits else d > edits


def components(links):
    """The smallest name that each linked name reaches."""
    root = {x: x for pair in links for x in pair}
    while any(root[x] != root[y] for x, y in links):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    return root


@pytest.mark.parametrize("most_shared", [2, 24])
def test_line_join_equals_brute_force(spark, most_shared):
    rng = np.random.default_rng(9)
    base = [prose(100 + i, 8) for i in range(12)]
    rows = []
    for d in range(90):
        chosen = [edited(rng, base[rng.integers(0, 12)], int(rng.integers(0, 4))) for _ in range(rng.integers(0, 4))]
        rows.append((d, "\n".join([*chosen, " short ", ""]), "x"))
    rows += [(5, rows[5][1], "again"), (5, base[0] + "!", "other text"), (None, base[0], "x"), (200, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string").repartition(4)
    join = lines.LineJoin(df, "text", "doc_id", 2, most_shared)
    places = {(d, i, x.strip(" \t\r")) for d, t, _ in rows if d is not None and t is not None for i, x in enumerate(t.split("\n"))}
    places = {p for p in places if len(p[2]) >= lines.SHORTEST}
    first = {}
    for d, i, x in sorted(places):
        first.setdefault(x, (d, i))
    long = [x for x in first if len(x) >= lines.SHORTEST_NEAR]
    links = [(x, y) for n, x in enumerate(long) for y in long[n + 1 :] if distance(x, y) <= 2]
    root = components(links)
    rep = {x: min((y for y in root if root[y] == root[x]), key=first.get) for x in root}
    assert join.classes.count() == len(root)
    gone = {(d, i, x) for d, i, x in places if first[x] != (d, i) or rep.get(x, x) != x}
    assert {(r["doc"], r["line_no"]) for r in join.removals().collect()} == {(d, i) for d, i, _ in gone}
    kept = Counter()
    for d, t, other in rows:
        if d is not None and t is not None:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i, x.strip(" \t\r")) not in gone)
        kept[d, t, other] += 1
    assert Counter(tuple(r) for r in join.cleaned().collect()) == kept
    report = join.report().collect()
    assert len(report) == len(rows)
    by_text = Counter(x for link in links for x in link)
    class_of = components([(d, first[rep.get(x, x)][0]) for d, i, x in gone])
    assert {r["doc_id"]: r["class_id"] for r in report} == {d: class_of.get(d, d) for d, _, _ in rows}
    expected = Counter(d for d, _, x in places for _ in range(by_text[x]))
    assert {r["doc_id"]: r["n_links"] for r in report if r["doc_id"] is not None} == {d: expected[d] for d, _, _ in rows if d is not None}


def test_variants_of_a_line_cost_in_proportion(spark):
    """300 lines that differ in one letter each: all in one class, and no more pairs than lines in the verification."""
    base = prose(7, 12)
    texts = [base[:i] + c + base[i + 1 :] for i in range(5, 35) for c in "0123456789"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    compared = []

    class Counted(lines.LineJoin):
        def _verified(self, pairs, known):
            compared.append(pairs.where("a <> c").select(F.least("a", "c"), F.greatest("a", "c")).distinct().count())
            return super()._verified(pairs, known)

    join = Counted(df, "text", "doc_id")
    assert join.removals().count() == 299 and {r["class_id"] for r in join.report().collect()} == {0}
    assert sum(compared) < 30 * len(texts)


def test_links_inside_a_class_are_counted(spark, monkeypatch):
    """Lines of a class link to each other, not to its first line alone, also where a crowd is cut into blocks."""
    monkeypatch.setattr(lines, "BLOCK_LINES", 8)
    base, other = prose(7, 12), prose(8, 12)
    texts = [base[:i] + c + base[i + 1 :] for i in range(5, 35, 3) for c in "0123456789"]
    chain = [other, other + "ab", other + "abcd", other + "abcd", other + "abc"]
    df = spark.createDataFrame([*enumerate(texts), *enumerate(chain, 1000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in lines.LineJoin(df, "text", "doc_id").report().collect()}
    assert {got[i] for i in range(len(texts))} == {len(texts) - 1}
    assert [got[1000 + i] for i in range(5)] == [1, 3, 2, 2, 2]


def test_line_join_of_odd_tables(docs, nothing):
    join = lines.LineJoin(docs, "text", "doc_id")
    assert join.cleaned().count() == docs.count() and join.cleaned().columns == docs.columns
    assert {r["doc_id"]: r["removed"] for r in join.report().collect()}[15] == "1"
    assert lines.LineJoin(nothing, "text", "doc_id").report().count() == 0


# ---- web archives


def test_archives_hold_their_captures(spark):
    payloads = [None, "", "a\r\n\r\nWARC/1.1\r\nb", "same é", "same é", "x" * 100_000, "\r\n\r\n", "tail\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", p, "x") for i, p in enumerate(payloads)], "page_id long, url string, html string, type string")
    path = scratch_folder(spark, "test-warc")
    warc.write_captures(pages, path, "page_id", "url", "html")
    records = warc.read_records(spark, path)
    assert records.groupBy("type").count().count() == 4 and records.count() == 3 * len(payloads)
    captures = warc.assemble(records).select(warc.metadata_field("id").cast("long").alias("id"), "response", "request", "metadata").collect()
    last = {(p or "").encode(): i for i, p in enumerate(payloads)}
    assert sorted(c["id"] for c in captures) == list(range(len(payloads)))
    for c in captures:
        body = (payloads[c["id"]] or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert c["response"]["digest"] == digest and c["request"]["target"] == f"http://h/{c['id']}"
        if last[body] == c["id"]:
            assert c["response"]["type"] == "response" and bytes(c["response"]["payload"]) == body
        else:
            assert c["response"]["type"] == "revisit" and c["response"]["refers_to"] is not None


def test_captures_with_repeated_ids_and_odd_urls(spark, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 40)
    monkeypatch.setattr(warc, "MOST_BYTES", 100)
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "a\r\nb: c", "x"), (3, "u", "x" * 50), (3, None, "y"), (4, "u", "x" * 50), (5, "u", "z" * 90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_folder(spark, "test-warc")
    warc.write_captures(pages, path, "page_id", "url", "html")
    captures = warc.assemble(warc.read_records(spark, path)).select(
        warc.metadata_field("id").cast("long").alias("id"), warc.metadata_field("refers-to-id").cast("long").alias("first"),
        F.col("response.type").alias("type"), F.col("request.target").alias("target"),
    )
    got = sorted((r["id"], r["type"], r["first"] or 0) for r in captures.collect())
    assert got == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (3, "response", 0), (3, "revisit", 4), (4, "response", 0), (5, "response", 0)]
    assert {r["target"] for r in captures.where("id = 2").collect()} == {"a%0D%0Ab: c"}
    empty = scratch_folder(spark, "test-warc")
    warc.write_captures(pages.limit(0), empty, "page_id", "url", "html")
    assert warc.read_records(spark, empty).count() == 0


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    path = scratch_folder(spark, "test-warc")
    warc.write_captures(pages, path, "page_id", "url", "html", least=3)
    kinds = Counter(r["type"] for r in warc.read_records(spark, path, with_payload=False).collect())
    assert (kinds["response"], kinds["revisit"]) == (3, 1)


def test_archive_reader_by_member_and_truncated():
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    whole = list(warc.records_of(gzip.compress(record) + gzip.compress(record)))
    assert [b for _, b in whole] == [b"ab\r\n"] * 2
    with pytest.raises(ValueError):
        list(warc.records_of(record[:-7]))


def test_archives_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_folder(spark, "test-warc")
    warc.write_captures(pages, path, "page_id", "url", "html")
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


# ---- quality


def test_quality_agrees_with_labels_it_never_saw(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scorer, model = quality.train(docs)
    rows = quality.scored(docs, scorer).join(labels, "doc_id").select("score", "quality").collect()
    assert np.mean([(s >= quality.KEEP) == (q == 1) for s, q in rows]) > 0.9
    assert (model.accuracies() > 0.5).all()


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    votes = np.stack([np.where(rng.random(20000) < 0.2, -1, np.where(truth, rng.random(20000) > 0.005, rng.random(20000) > p)) for p in (0.9, 0.8, 0.7, 0.6)], 1)
    patterns, counts = np.unique(votes.astype(int), axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.given[0, :, 0] - np.array([0.9, 0.8, 0.7, 0.6])).max() < 0.06


def test_quality_of_odd_tables(docs, nothing):
    scorer, _ = quality.train(docs)
    assert quality.scored(docs, scorer).count() == docs.count()
    scorer, model = quality.train(nothing)
    assert model is None and quality.scored(docs, scorer).where("score = 0.5").count() == docs.count()


# ---- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>"<p>no</p>"</script></head><body class="home">
<div class="promo-free"><p>Site motto that is everywhere</p></div><nav><ul><li>menu</ul></nav><div id="cookie-notice">ok?</div>
<article><header><h1>Head &amp; {n}</h1></header><p>One  <b>bold</b>
text {n}<p>Two &lt;{n}&gt;<br>more<ul><li>item<li>other</ul><p>Printed everywhere<form>in</form><section class="comments"><p>reader</p></section></article>
<aside>side</aside><footer>foot {n}</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://A.example/{i}", PAGE.format(n=i), "x") for i in range(8)]
    bare = "<body><div><p>Welcome to us</p></div><div><p>Story {n} here</p></div></body>"
    rows += [(100 + i, f"https://b.example:80/{i}", bare.format(n=i), "x") for i in range(8)]
    rows += [(200, None, None, None), (201, "u", "", "x"), (202, "http://c/", "no markup &eacute;", "x"), (0, "http://A.example/0", PAGE.format(n=0), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    expected = "Head & {n}\n\nOne bold text {n}\n\nTwo <{n}> more\n\nitem\n\nother\n\nPrinted everywhere"
    for most in (200_000, 0):
        found = {r["page_id"]: r["text"] for r in templates.extract(pages, most_shipped=most).collect()}
        assert len(found) == len(rows) - 1
        assert all(found[i] == expected.format(n=i) for i in range(8))
        assert all(found[100 + i] == f"Story {i} here" for i in range(8))
        assert (found[200], found[201], found[202]) == ("", "", "no markup é")


def test_templates_equal_brute_force(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").withColumn("host", templates.host_of("url"))
    found = {(r["host"], r["hash"]) for r in templates.templates(pages, "html", "host", 2, 0.1).collect()}
    counts, sites = Counter(), Counter()
    for r in pages.collect():
        sites[r["host"]] += 1
        for h in set(templates.subtree_hashes(templates.parse(r["html"])).values()):
            counts[r["host"], h] += 1
    assert found == {k for k, n in counts.items() if n >= 2 and n >= 0.1 * sites[k[0]]}


def test_main_text_is_the_article_of_the_pages(spark, folder):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    from html import unescape

    for r in catalog.QUERIES["op5_html"](spark, folder).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


# ---- toxicity


def test_toxicity_on_held_out_labels(spark, folder):
    rows = catalog.QUERIES["op6_toxicity"](spark, folder).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_toxicity_finds_unseen_spellings(spark):
    rng = np.random.default_rng(4)
    bad = ["vequis", "vequan", "vequor", "vequet", "vequum", "trash"]
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(WORDS, rng.integers(5, 60)).tolist()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    labels += [(None, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = prose(3, 400)
    assert scorer.score(clean) < 0.3 and scorer.score("") < 0.5
    assert scorer.score(clean + " vequad " + clean) > 0.7 and scorer.score("alpha beta vequisse gamma") > 0.7


def test_toxicity_after_the_beginning_of_a_long_run(spark):
    rng = np.random.default_rng(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 60)]
    bad = "\u6bd2\u9aa8\u9634\u8c0b\u6740"

    def run(n, toxic):
        text = "".join(rng.choice(letters, n))
        at = int(rng.integers(70, n))
        return text[:at] + bad + text[at:] if toxic else text

    rows = [(i, run(int(rng.integers(100, 400)), i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert min(scorer.score(run(300, True)) for _ in range(20)) > 0.7 > max(scorer.score(run(300, False)) for _ in range(20))
    for n in (32, 33, 36, 37, 100, 1000):
        word = "".join(rng.choice(letters, n))
        grams = {word[i : i + 5] for i in range(n - 4)}
        assert grams <= {p[i : i + 5] for p in toxicity.words_of(word) for i in range(len(p) - 4)}


def test_shapes_are_of_whole_words():
    word = b"aB" * 100
    assert quality.features(word + b"1") != quality.features(word + b"-") != quality.features(word)
    assert quality.features(b"a" * 70 + b"9") == quality.features(b"aa9") != quality.features(b"a" * 71)


def test_toxicity_of_odd_tables(docs, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.train(docs, labels)
    assert len({r["score"] for r in toxicity.scored(docs, scorer, name="s").select(F.col("s").alias("score")).collect()}) >= 1
    assert toxicity.accepted(docs, scorer).columns == docs.columns
    assert toxicity.accepted(nothing, scorer).count() == 0


# ---- SimHash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", norm(text)) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values, linked):
    component = list(range(len(values)))
    for _ in values:
        for i in range(len(values)):
            for j in range(len(values)):
                if linked(values[i], values[j]):
                    component[i] = component[j] = min(component[i], component[j])
    return component


def test_simhash_equals_brute_force(docs, nothing):
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    component = reachable(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for r, c in zip(rows, component):
        if r["doc_id"] is not None:
            least[c].append(r["doc_id"])
    expected = Counter((r["doc_id"], f"{p:016x}", min(least[c], default=None)) for r, p, c in zip(rows, prints, component))
    found = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fingerprint")), "component_id")
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted({c for _, _, c in expected if c is not None})


@pytest.mark.parametrize("shard_rows", [2, 1024])
def test_links_of_fingerprints_equal_brute_force(spark, shard_rows):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 2**63, 30)]
    for v in list(values):
        for _ in range(4):
            values.append(v ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    values += [7 << 30 | i for i in range(80)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = {r["node"]: r["root"] for r in smallest_reachable(simhash.links(df, shard_rows)).collect()}
    component = reachable(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert all(roots.get(v, v) == signed[c] for v, c in zip(signed, component))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    roots = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {roots[i] for i in range(61)} == {0} and {roots[1000 + i] for i in range(200)} == {1000}
    assert 5000 not in roots


# ---- decontamination


def brute_contained(text, items, size=10):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", norm(t)) if w]
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        for i in range(max(1, len(own) - size + 1)) if own else ():
            w = own[i : i + size]
            for s in range(len(words) - len(w) + 1):
                if words[s : s + len(w)] == w:
                    hit |= set(range(s, s + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_decontamination_equals_brute_force(spark, docs, block_bytes):
    passage = prose(50, 14)
    items = [("a", passage), ("b", "short item"), ("c", passage.upper()), ("d", None), ("e", "..."), (None, "alpha"), ("f", prose(2, 11)), ("g", "É-é x")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    more = spark.createDataFrame(
        [(100, "pre " + passage.replace(" ", " - ") + " post", "s", 1), (101, "a SHORT, item; short item", "s", 1), (102, " ".join(passage.split()[:9]), "s", 1),
         (103, passage + " " + passage, "s", 1), (104, "x é", "s", 1), (105, "É é x", "s", 1)], docs.schema,
    )
    every = docs.unionByName(more)
    found = decontaminate.contained(every, bench, keep=("doc_id", "text"), block_bytes=block_bytes).collect()
    named = [(i, t) for i, t in items if i is not None and t is not None]
    for r in found:
        n, hit, ids = brute_contained(r["text"], named)
        assert (r["n_words"], sum(e - s for s, e in zip(r["starts"], r["ends"])), r["item_ids"]) == (n, hit, ids)
    kept = decontaminate.clean(every, bench)
    assert kept.columns == every.columns
    assert kept.count() == sum(not r["starts"] for r in found)
    assert decontaminate.clean(every, bench.limit(0)).count() == every.count()


def test_benchmark_items_without_an_id_hit(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    items = [("a", prose(50, 14)), (None, "only " + prose(51, 12)), (None, prose(50, 14)), (None, None), (None, "..."), ("b", prose(52, 11))]
    texts = [prose(50, 14), "x only " + prose(51, 12), prose(52, 11) + " and only " + prose(51, 12), "clean", None]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["op8_decontamination"](spark, str(tmp_path)).orderBy("doc_id").collect()
    db = duckdb.connect()
    for name in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert [tuple(r) for r in found] == db.execute(catalog.SQL["op8_decontamination"] + " ORDER BY doc_id").fetchall()
    assert [r["contaminated"] for r in found] == [True, True, True, False, False]
    kept = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]


# ---- exact duplicates


def test_exact_duplicates_equal_brute_force(docs, nothing):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    expected = Counter()
    for r in rows:
        ids = groups[norm(r["text"])]
        keep = max((i for i in ids if i is not None), default=None)
        expected[r["doc_id"], keep, len(ids), r["doc_id"] == keep, hashlib.sha256(norm(r["text"]).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact.exact_duplicates(docs).collect()) == expected
    assert exact.exact_duplicates(nothing).count() == 0


def test_filters_merge_losslessly():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << 12, n).astype(np.uint64) << np.uint64(20) | rng.integers(0, 4, n).astype(np.uint64) for n in (0, 1, 300, 2000)]
    filters = [exact.QuotientFilter.of(*exact.counted(p, np.ones(len(p))), 40, 6) for p in parts]
    for order in (filters, filters[::-1]):
        keys, counts = exact.merged(order).items()
        assert dict(zip(keys.tolist(), counts.tolist())) == Counter(np.concatenate(parts).tolist())
        assert (np.diff(keys.astype("int64")) > 0).all()


def test_bytes_decide_where_fingerprints_collide(docs):
    whole = Counter(tuple(r) for r in exact.exact_duplicates(docs).collect())
    assert Counter(tuple(r) for r in exact.exact_duplicates(docs, bits=2).collect()) == whole


# ---- secrets

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


SECRETS = [
    "", "password=abcdef", "PassWord : 'abc'", "é token=tok: abcdefgh", "api_key=\"x.y-z/9+=\" apikey:123456", "é" * 9 + "AKIA" + "A1" * 8 + "b",
    "AKIA" + "B" * 15, "0123456789abcdef" * 2 + " x", "deadbeef" * 3 + "password=" + "ab12" * 8, "secret=password=token=zzzzzz", "ſecret=abcdef toKen=abcdef",
]


@pytest.mark.parametrize("random", ["kDxjfLqZmXvTtRwPpYsNbbQhGz", "kD93jfLq0ZmX81vTtR4"])
def test_random_strings_need_no_digit_and_no_fixed_length(spark, folder, random):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    keys = spark.createDataFrame([(-i, "token = " + "".join(rng.choice(letters, 40))) for i in range(1, 200)], docs.schema)
    plain = "getElementsByTagName HttpServletRequestWrapper MAX_CONNECTION_RETRIES x86_64-unknown-linux-gnu internationalization"
    probe = spark.createDataFrame([(1, f"so {random} it is"), (2, plain)], docs.schema)
    ratio = secret_scan.train(docs.union(keys))
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(probe, ratio).collect()}
    assert found == {1: [("random", 3, 3 + len(random))], 2: []}


def test_secret_patterns_and_model(spark, folder):
    rows = [(i, t, "x") for i, t in enumerate(SECRETS)] + [(99, None, "x"), (None, "password=abcdef", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    corpus = spark.read.parquet(f"{folder}/documents.parquet")
    ratio = secret_scan.train(corpus.select("text").union(docs.select("text")))
    for r in secret_scan.scan(docs, ratio, keep=("text",)).select("text", F.col("spans").alias("found")).collect():
        base = [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in r["found"] if s["kind"] != "random"]
        assert base == brute_base(r["text"] or "")
    for r in secret_scan.scan(corpus, ratio, keep=("text",)).collect():
        assert [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "random"] == brute_base(r["text"])
    hidden = "see é kD93jfLq0ZmX81vTtR4wPpY2sNbb7 here"
    assert secret_scan.spans_of(hidden.encode(), ratio) == [(6, 3, 35)]
    assert secret_scan.spans_of(b"theinternationalidentifier1 and_so_on_and_so_on_2", ratio) == []


def test_pair_counts_are_of_all_documents(spark, docs, nothing):
    assert not secret_scan.train(nothing).any()
    assert secret_scan.scan(nothing, secret_scan.train(docs)).count() == 0
    random, plain = secret_scan.pair_counts(b"password=a1b2c3 ab ab")
    assert random.sum() == 5 and plain[[secret_scan._SYMBOLS[97] * secret_scan._N + secret_scan._SYMBOLS[98]]].sum() == 2
