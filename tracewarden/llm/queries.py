"""The registered queries of this subpackage: thin views on the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import bit_sliced, html_consensus, license_scan, line_dedup, phrases, pu_quality, secret_scan, sentencepiece_bpe, simhash_ring, source_mixing, url_filter, vector_codes, winnowing
from tracewarden.llm.common import read
from tracewarden.llm.licence_texts import TEXTS
from tracewarden.llm.secret_labels import labelled_findings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """File of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


#: Rules of the contract.
URL_RULES = [
    url_filter.Rule("org", "/", True),
    url_filter.Rule("example.org", "/es/", False),
    url_filter.Rule("example.org", "/en/1", False),
    url_filter.Rule("com", "/fr/", True),
    url_filter.Rule("com", "/de/", False),
]
#: The small labelled table: words of hosts and paths that are to be blocked, and ordinary ones.
BLOCKED_WORDS = "casino win bets betting poker slots jackpot lottery pills cheap pharma viagra spam farm link-farm adult xxx x porn cams escort ads track tracker tracking adserver banner popup click clicks malware phish free-money loans payday crypto-win torrent warez crack keygen free-spins".split()
ORDINARY_WORDS = "news daily times herald river garden kitchen school library science history travel weather health doctor music books cinema theatre nature forest mountain harbour village market museum letters reading writing teacher student city council research journal review archive atlas bridge".split()
ORDINARY_WORDS += "world sport business article story people family animals cooking recipe language culture politics economy science-report interview opinion photo video guide lesson course project team contact about profile report paper essay chapter question answer help support product catalogue winter summer stone water light house street north south eastern western morning evening friend mother brother winner window beautiful electric common general public national company history-of-art learning".split()
ORDINARY_WORDS += "nachrichten zeitung wetter schule garten reise wissen gesundheit stadt leben maison jardin livre ville voyage histoire noticias tiempo escuela ciudad libro viaje salud historia en de fr es index home page item".split()
DOMAINS = ["com", "net", "org", "info", "de", "fr", "es", "co.uk", "example.com"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, block): each word in hosts and in paths of several shapes; the rest of such a url is ordinary.

    A blocked word stands as often in the path of an ordinary host as in a host with an ordinary path,
    so that both halves of the classifier learn.
    """
    words = spark.createDataFrame([(w, True) for w in BLOCKED_WORDS] + [(w, False) for w in ORDINARY_WORDS], "word string, block boolean")
    spread = lambda *x: F.explode(F.array(*x))
    some = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(salt), "shape", "word"), F.lit(len(values))) + 1).cast("int"))
    a, b, top = some(ORDINARY_WORDS, 1), some(ORDINARY_WORDS, 2), some(DOMAINS, 3)
    number = F.pmod(F.xxhash64(F.lit(4), "shape", "word"), F.lit(10_000)).cast("string")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    w = F.col("word")
    rows = words.withColumn("shape", spread(*map(F.lit, range(12))))
    hosts = [text(w), text("www.", w), text(w, "-", a), text(a, "-", w), text(w, "s"), text("m.", w, a)]
    plain = [text("/"), text("/", a), text("/", a, "/", number), text("/", number, "/", b, "-", a, ".html"), text("/", b, "/"), text("/", a, "-", b)]
    paths = [text("/", w), text("/", w, "/", a), text("/", a, "/", w), text("/", b, "-", w, "-", a), text("/", number, "/", w, ".html"), text("/", w, "-", number, "/")]
    pick = lambda values: F.element_at(F.array(*values), (F.pmod("shape", F.lit(6)) + 1).cast("int"))
    in_host = text("https://", pick(hosts), ".", top, pick(plain))
    in_path = text("https://", some(["", "www.", "blog."], 5), a, ".", top, pick(paths))
    return rows.select(F.when(F.col("shape") < 6, in_host).otherwise(in_path).alias("url"), "block")


@query("op1_url_filter")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    model = url_filter.train(labelled_urls(spark))
    return url_filter.judge(read(spark, folder, "pages"), URL_RULES, model)


OP2_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
p AS (SELECT id, len(q) AS size, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM v),
s AS (
  SELECT a.id AS query_id, b.id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM p a JOIN p b ON a.i = b.i AND a.size = b.size AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query("op2_bit_sliced_top_k", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best candidates of every vector whose id is divisible by 100."""
    vectors = bit_sliced.quantised(read(spark, folder, "embeddings"))
    return bit_sliced.top_k(vectors, vectors.where(F.col("id") % 100 == 0), 10)


@query("op3_winnowing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    rows = winnowing.compared(read(spark, folder, "documents"))
    kept = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        *(F.sha2(F.array_join(F.col(c).cast("array<string>"), " ").cast("binary"), 256).alias(d) for c, d in (("marks", "fingerprint"), ("edited_marks", "edited_fingerprint"))),
        *(winnowing.hashes(F.col(c)).alias(c) for c in ("marks", "edited_marks", "next_marks")),
    )
    return kept.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        winnowing.likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        winnowing.likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
        F.size("marks").alias("n_marks"),
    )


@query("op4_pu_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; labels of held-out ids are never seen."""
    docs = read(spark, folder, "documents")
    model = pu_quality.train(docs, read(spark, folder, "labels"))
    scored = pu_quality.score(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", pu_quality.held_out().alias("held_out"), "score", "predicted")


#: Target shares of tokens by language.
MIXTURE = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


@query("op5_source_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of every document so that the expected tokens of the languages reach their shares."""
    rated, names, error = source_mixing.rated(read(spark, folder, "documents"), read(spark, folder, "labels"), "lang", MIXTURE)
    best = F.array_max(F.transform("p", lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    name = F.array(*map(F.lit, names))[-best["i"]] if names else F.lit(None).cast("string")
    return rated.select(
        "doc_id", F.col("tokens").alias("n_tokens"), name.alias("domain"), best["p"].alias("posterior"), "rate", source_mixing.copies(F.col("rate")).alias("copies"),
        F.lit(error).alias("total_error"),
    )


def _templates_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(t.licence)}, {quote(t.form)}, {quote(t.text)})" for i, t in enumerate(sorted(TEXTS, key=lambda t: (t.licence, t.form))))


def _bigrams_sql(body: str) -> str:
    words = f"string_split(trim(regexp_replace(lower({body}), '[^a-z0-9ß-ɏ]+', ' ', 'g')), ' ')"
    return f"list_distinct(list_transform(list_zip({words}[:-2], {words}[2:]), lambda x: x[1] || ' ' || x[2]))"


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, string_split_regex(text, '\\n\\s*\\n') AS gaps FROM d),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(lines))) AS number, unnest(lines) AS body FROM p
  UNION ALL SELECT doc_id, 'block', unnest(range(len(gaps))), unnest(gaps) FROM p WHERE len(gaps) > 1
  UNION ALL SELECT doc_id, 'text', 0, text FROM p WHERE len(lines) > 1),
b AS (SELECT doc_id, unit, number, {_bigrams_sql("body")} AS b FROM u WHERE length(body) > 4),
t AS (SELECT k, licence, form, {_bigrams_sql("body")} AS b FROM (VALUES {_templates_sql()}) v(k, licence, form, body)),
m AS (
  SELECT doc_id, unit, number, licence, form, k, 2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice
  FROM b JOIN t ON len(b.b) > 0 AND len(b.b) BETWEEN len(t.b) * 0.66 AND len(t.b) * 1.51)
SELECT doc_id, unit, CAST(number AS INTEGER) AS number, licence, form, dice FROM m WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, k) = 1
"""


@query("op6_license_scan", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every line, block or document that is a licence text or notice."""
    return license_scan.scan(read(spark, folder, "documents"), TEXTS)


@query("op7_sentencepiece_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    return sentencepiece_bpe.digests(read(spark, folder, "documents"), model_path())


@query("op8_html_consensus")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    text = html_consensus.extract(read(spark, folder, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


@query("op9_line_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """For every document the numbers of its lines that an earlier line matches, and the digest of the rest."""
    rows, lines = line_dedup.marked(read(spark, folder, "documents").select("doc_id", "text"))
    left = F.when(F.col(lines).isNull(), F.col("text")).otherwise(line_dedup.without(F.col("text"), F.col(lines)))
    count = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    removed = F.coalesce(F.size(F.array_distinct(lines)), F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        count.alias("n_lines"),
        F.when(F.col(lines).isNull(), F.lit(0)).otherwise(removed).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(lines, ","), F.lit("")).alias("removed_lines"),
        F.sha2(F.coalesce(left, F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


@query("op10_simhash_ring")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_ring.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


@query("op11_secret_scan")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document: counts and digest of the base ones, and all."""
    net = secret_scan.train(labelled_findings(spark))
    rows = secret_scan.scan(read(spark, folder, "documents"), net)
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "net")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, unnest(list_transform(range(1, least(5, len(w) - i + 1) + 1), lambda m: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM s),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE contains(phrase, ' ')),
k AS (SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM c),
q AS (
  SELECT k.lang, k.phrase, k.w, k.a, k.k, x.a AS l, y.a AS r, t.n::BIGINT AS n, ((1000::HUGEINT * k.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM k JOIN f x ON k.lang = x.lang AND array_to_string(k.w[1:k.k], ' ') = x.phrase
  JOIN f y ON k.lang = y.lang AND array_to_string(k.w[k.k + 1:], ' ') = y.phrase JOIN t ON k.lang = t.lang),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT lang, w, a, i, unnest(range(2, least(len(w) - 1, len(w) - i + 1) + 1)) AS m FROM (SELECT lang, w, a, unnest(range(1, len(w) + 1)) AS i FROM c)) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN h ON b.lang = h.lang AND b.phrase = h.phrase WHERE h.held IS NULL OR 100 * h.held < 100 * b.a) WHERE rank <= 2000
"""


@query("op12_phrases", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of each language that hold together best."""
    return phrases.collocations(read(spark, folder, "documents"))


def _lloyd_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Lloyd rounds over vectors of one length as a chain of common table expressions."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (
  SELECT p.row, p.pos, b.entry, sum((p.x - b.c) * (p.x - b.c)) AS distance FROM p JOIN b{k} b ON p.pos = b.pos AND p.i = b.i GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT row, pos, entry, distance FROM d{k} QUALIFY row_number() OVER (PARTITION BY row, pos ORDER BY distance, entry) = 1)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT p.pos, a.entry, p.i, sum(p.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM p JOIN a{k} a ON p.row = a.row AND p.pos = a.pos GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, b.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, b.c)::BIGINT AS c FROM b{k} b LEFT JOIN s{k} s ON b.pos = s.pos AND b.entry = s.entry AND b.i = s.i)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
w AS (SELECT row, len(q) AS dim, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS j FROM v),
p AS MATERIALIZED (SELECT row, j // (dim // {parts}) AS pos, j % (dim // {parts}) AS i, x FROM w),
f AS (SELECT row, row_number() OVER (ORDER BY vec_id, q) - 1 AS entry FROM v QUALIFY entry < {entries}),
b0 AS MATERIALIZED (SELECT p.pos, f.entry, p.i, p.x AS c FROM p JOIN f ON p.row = f.row),
{",".join(steps)},
c AS (
  SELECT row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY pos) AS code, sum(distance)::BIGINT AS error FROM a{rounds} GROUP BY row)
SELECT v.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY pos, entry, i)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN c ON v.row = c.row
"""


@query("op13_vector_codes", _lloyd_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Code of every vector, its error and the error of all vectors with its label."""
    rows = vector_codes.with_label_errors(vector_codes.coded(read(spark, folder, "embeddings")))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
