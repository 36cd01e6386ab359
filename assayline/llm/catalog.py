"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import bpe, collocations, decontaminate, exact, lines, periodic, quality, secret_scan, simhash, suffix_tree, templates, toxicity, warc
from assayline.llm.common import table
from assayline.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_line_dedup")
def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.LineJoin(table(spark, folder, "documents"), "text", "doc_id").report()


@query("op2_bpe")
def _bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe.read_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer, "text", keep=("doc_id",))


# Base32 of a hexadecimal SHA-1 takes its 160 bits five at a time.
_SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41),
        lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(1, 6), lambda j: (substr(bits, 5 * i + j, 1))::INTEGER * (1 << (5 - j))))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b"""


@query("op3_warc", _SQL_WARC)
def _warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_folder(spark, "warc")
    warc.write_captures(table(spark, folder, "pages"), archive, "page_id", "url", "html", least=0)
    captures = warc.assemble(warc.read_records(spark, archive, with_payload=False))
    revisit = F.col("response.type") == "revisit"
    return captures.select(
        warc.metadata_field("id").cast("long").alias("page_id"),
        F.when(revisit, warc.metadata_field("payload-bytes").cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        warc.metadata_field("refers-to-id").cast("long").alias("refers_to"),
    )


@query("op4_quality")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scorer, _ = quality.train(docs, "text", "doc_id")
    return quality.scored(docs, scorer, "text", ("doc_id",)).select(
        "doc_id", "score", (F.col("score") >= quality.KEEP).alias("kept")
    )


@query("op5_html")
def _html(spark: SparkSession, folder: str) -> DataFrame:
    found = templates.extract(table(spark, folder, "pages"), "html", "url", ("page_id", "url"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op6_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scorer = toxicity.train(docs, labels.where(~toxicity.held_out()), "text", "doc_id", "toxic")
    return toxicity.scored(docs, scorer, "text", ("doc_id",)).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted")
    )


@query("op7_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), "text", "doc_id")
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


_SQL_DECONTAMINATION = r"""
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM norm),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM places) p
    JOIN windows x ON x.n = p.n AND x.s = p.s),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)"""


@query("op8_decontamination", _SQL_DECONTAMINATION)
def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"), unnamed=True)
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + (s["ends"] - s["starts"]).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


_SQL_EXACT = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""


@query("op9_exact_dedup", _SQL_EXACT)
def _exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"), "text", "doc_id")


@query("op10_secrets")
def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    spans = secret_scan.scan(docs, secret_scan.train(docs, "text"), "text", ("doc_id",))

    def text_of(kept):
        return F.array_join(
            F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return spans.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


@query("op11_lm_scoring")
def _language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs, learnt = table(spark, folder, "documents"), ~suffix_tree.held_out()
    model, words = suffix_tree.train(docs.where(learnt), "text")
    found = suffix_tree.scored(docs, model, words, "text", ("doc_id",), learnt)
    return found.select(
        "doc_id", suffix_tree.held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the id says so, the words from one place on repeat a few words from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    moved = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def _periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, folder, "documents")), "text", ("doc_id",))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))["run"]
    lines_ = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    digest = F.sha2(F.concat(F.array_join(lines_, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest.alias("runs_sha256"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256",
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


_SQL_COLLOCATIONS = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS c
    FROM (SELECT *, unnest([1, 2, 3]) AS k FROM i) WHERE i + k - 1 <= len(w) GROUP BY ALL),
f AS (SELECT * FROM g WHERE c >= 10),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
p AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 1),
cuts AS (SELECT p.lang, p.phrase, p.k, p.c AS a, x.c AS l, y.c AS r, j,
      ((1000000::HUGEINT * p.c * p.c) // (x.c::HUGEINT * y.c))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM p) p
    JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.s[1 : p.j], ' ')
    JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.s[p.j + 1 : p.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(s[1:2], ' ') AS phrase, c AS a FROM p WHERE k = 3 UNION ALL
    SELECT lang, array_to_string(s[2:3], ' '), c FROM p WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON b.k = 2 AND o.lang = b.lang AND o.phrase = b.phrase
    WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""


@query("op13_collocations", _SQL_COLLOCATIONS)
def _collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), "text", "lang")
