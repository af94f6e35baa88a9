"""Queries over derived columns, parameters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.functions import audit, net, scores, text, uri
from tracewarden.functions.scores import first_of
from tracewarden.operators import params as pr
from tracewarden.operators import verdict
from tracewarden.operators.joins import url_allowlist
from tracewarden.plans.registry import EVENTS_SQL, events, query, table, texts
from tracewarden.tables import values_sql


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1)"
PAIRS_SQL = f"""pp AS (SELECT page_id, url, unnest(list_filter(string_split({QUERY}, '&'), lambda x: contains(x, '='))) AS pair FROM pages),
qp AS (SELECT page_id, url, split_part(pair, '=', 1) AS name, regexp_replace(pair, '^[^=]*=', '') AS value FROM pp)"""


def pages(spark, d):
    return texts(spark, d, "pages")


def documents(spark, d):
    return texts(spark, d, "documents")


@query("p1_json_params", """
SELECT event_id, 'json' AS position, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events""")
def _(spark, d):
    return pr.explode_params(events(spark, d), ["event_id"], {"json": pr.json_params(F.col("props"))})


@query("p1_query_params", f"WITH {PAIRS_SQL} SELECT page_id, 'query' AS position, name, value FROM qp")
def _(spark, d):
    return pr.url_params(pages(spark, d), ["page_id"], "url")


@query("p2_template_prefix_ids", rf"""
SELECT page_id, regexp_replace(regexp_replace({PATH}, '/\d+', '/{{id}}', 'g'), '/[0-9a-f]{{16,}}', '/{{hash}}', 'gi') AS template FROM pages""")
def _(spark, d):
    return pages(spark, d).select("page_id", uri.template_prefix_ids(F.col("url")).alias("template"))


@query("p3_template_segments", rf"""
SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split({PATH}, '/'), lambda s: s <> ''),
  lambda s: CASE WHEN regexp_matches(s, '^\d+$') THEN '{{id}}' WHEN regexp_matches(s, '^[0-9a-fA-F]{{8,}}$') THEN '{{hash}}' ELSE s END), '/') AS template FROM pages""")
def _(spark, d):
    return pages(spark, d).select("page_id", uri.template_segments(F.col("url")).alias("template"))


@query("p4_pattern_id", rf"""
WITH {PAIRS_SQL}, n AS (SELECT page_id, string_agg(name, ',' ORDER BY name) AS names FROM qp GROUP BY 1),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '\?.*$', ''), '/(\d+)$', '/{{id}}'), '/(\d+)/', '/{{id}}/', 'g') AS template FROM pages)
SELECT page_id, template, md5('GET|' || template || '|' || coalesce(names, '')) AS pattern FROM t LEFT JOIN n USING (page_id)""")
def _(spark, d):
    t = pages(spark, d).withColumn("template", uri.template_ids(F.col("url")))
    names = F.transform(uri.query_pairs(F.col("url")), lambda p: p["name"])
    return t.select("page_id", "template", uri.pattern_id(F.lit("get"), F.col("template"), names).alias("pattern"))


@query("p5_path_parts", rf"""
WITH p AS (SELECT page_id, {PATH} AS path FROM pages), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p)
SELECT page_id, path, coalesce(seg[1], '') AS first, len(seg) AS depth, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS extension,
  regexp_matches(path, '\.(?:css|js|png|html)$') AS static FROM s""")
def _(spark, d):
    p = pages(spark, d).select("page_id", uri.path_of(F.col("url")).alias("path"))
    seg = uri.segments(F.col("path"))
    return p.select("page_id", "path", F.coalesce(F.get(seg, F.lit(0)), F.lit("")).alias("first"), F.size(seg).cast("bigint").alias("depth"),
                    F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"),
                    uri.is_static(F.col("path"), ["css", "js", "png", "html"]).alias("static"))


@query("p6_request_signature", f"""
WITH {PAIRS_SQL}, n AS (SELECT page_id, string_agg(name || '=' || value, '&' ORDER BY name, value) AS ps FROM qp GROUP BY 1)
SELECT page_id, md5('GET|' || {PATH} || '|' || coalesce(ps, '')) AS signature FROM pages LEFT JOIN n USING (page_id)""")
def _(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", uri.request_signature(F.lit("get"), uri.path_of(u), uri.query_pairs(u)).alias("signature"))


# A path word stands in for the page's language so that every class occurs.
STAND_IN = {"en": "login", "fr": "search", "de": "admin/users", "es": "orders/cart"}


def worded(spark, d):
    u = F.col("url")
    for k, v in STAND_IN.items():
        u = F.regexp_replace(u, f"/{k}/", f"/{v}/")
    return pages(spark, d).withColumn("uri", u)


WORDED = "url"
for _k, _v in STAND_IN.items():
    WORDED = f"regexp_replace({WORDED}, '/{_k}/', '/{_v}/', 'g')"


@query("p7_scene", f"""
WITH u AS (SELECT page_id, {WORDED} AS url FROM pages)
SELECT page_id, CASE WHEN {PATH} LIKE '/login/%' OR {PATH} LIKE '/orders/cart/%' THEN CASE WHEN page_id % 2 = 0 THEN 'hard_skip' ELSE 'soft_skip' END
  WHEN {PATH} LIKE '/search/%' THEN 'soft_skip' ELSE 'full_check' END AS scene FROM u""")
def _(spark, d):
    m = F.when(F.col("page_id") % 2 == 0, "POST").otherwise("GET")
    return worded(spark, d).select("page_id", uri.scene(F.col("uri"), m).alias("scene"))


@query("p8_endpoint_kind", f"""
WITH u AS (SELECT page_id, {WORDED} AS url FROM pages), k AS (SELECT page_id, string_split({PATH}, '/')[2] AS s FROM u)
SELECT page_id, CASE s WHEN 'login' THEN 'login' WHEN 'search' THEN 'search' WHEN 'admin' THEN 'admin' WHEN 'orders' THEN 'payment' ELSE 'unknown' END AS kind,
  CASE s WHEN 'login' THEN 'pre_auth' WHEN 'search' THEN 'resource_or_post' WHEN 'admin' THEN 'high_privilege' WHEN 'orders' THEN 'resource_or_post' ELSE 'unknown' END AS flow FROM k""")
def _(spark, d):
    w = worded(spark, d).withColumn("kind", uri.endpoint_kind(F.col("uri")))
    flow = uri.flow_state(F.col("uri"), F.col("kind"))
    return w.select("page_id", "kind", F.when(flow.isin("resource_access", "post_auth"), "resource_or_post").otherwise(flow).alias("flow"))


@query("p9_message_class", """
WITH c AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, 'sql') OR contains(t, 'union') OR contains(t, 'select') THEN 'sql_injection'
  WHEN contains(t, 'xss') OR contains(t, 'script') OR contains(t, 'onerror') THEN 'xss'
  WHEN contains(t, '文件包含') OR contains(t, 'upload') OR contains(t, '上传') THEN 'file_upload'
  WHEN contains(t, 'cc') OR contains(t, '频繁') OR contains(t, 'rate') THEN 'rate_abuse' WHEN contains(t, '参数污染') THEN 'parameter_pollution'
  WHEN contains(t, '遍历') OR contains(t, '../') THEN 'path_traversal' WHEN contains(t, '命令') OR contains(t, 'exec') THEN 'command_injection' ELSE 'other' END AS class FROM c""")
def _(spark, d):
    return documents(spark, d).select("doc_id", audit.message_class(F.col("text")).alias("class"))


@query("p10_bands", f"""
WITH {EVENTS_SQL} SELECT event_id, CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value >= 20 THEN 'low' ELSE 'clean' END AS risk,
  CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value >= 15 THEN 'low' ELSE 'clean' END AS chain_risk,
  CASE WHEN value >= 75 THEN 'block' WHEN value >= 50 THEN 'observe' WHEN value >= 30 THEN 'log' ELSE 'pass' END AS action FROM ev""")
def _(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", scores.risk_band(v).alias("risk"), scores.chain_risk_band(v).alias("chain_risk"), scores.action_band(v).alias("action"))


COMMENT_SQL = r"regexp_replace({}, '(?is)/\*.*?\*/|--[^\n]*|#.*', ' ', 'g')"


@query("p11_decoded_text", rf"""
WITH a AS (SELECT doc_id, text AS x0 FROM documents),
b AS (SELECT *, replace(replace(replace(translate(x0, {sql_text(text.LOOK_FROM)}, {sql_text(text.LOOK_TO)}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe') AS x1 FROM a),
c AS (SELECT *, regexp_replace(x1, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{FEFF}}\x{{2060}}-\x{{2064}}]', '', 'g') AS x2 FROM b),
d AS (SELECT *, {COMMENT_SQL.format('x2')} AS x3 FROM c), e AS (SELECT *, regexp_replace(x3, '\s+', ' ', 'g') AS x4 FROM d), f AS (SELECT *, lower(x4) AS x5 FROM e)
SELECT doc_id, md5(trim(x5)) AS decoded, (x1 <> x0)::INT + (x2 <> x1)::INT + (x3 <> x2)::INT + (x4 <> x3)::INT + (x5 <> x4)::INT AS transforms,
  concat_ws(',', CASE WHEN x1 <> x0 THEN 'look_alike' END, CASE WHEN x2 <> x1 THEN 'invisible' END, CASE WHEN x3 <> x2 THEN 'comment' END,
    CASE WHEN x4 <> x3 THEN 'space' END, CASE WHEN x5 <> x4 THEN 'case' END) AS layers FROM f""")
def _(spark, d):
    # The folding layers; the decoding passes, which have no SQL counterpart, are in p11_decode_profile.
    r = text.decode_layers(documents(spark, d), "text", passes=0)
    return r.select("doc_id", F.md5("decoded").alias("decoded"), "transforms", F.concat_ws(",", "layers").alias("layers"))


@query("p11_decode_profile")
def _(spark, d):
    r = text.decode_layers(documents(spark, d), "text")
    return r.select("doc_id", "depth", "transforms", "complexity", F.concat_ws(",", "layers").alias("layers"), F.md5("decoded").alias("decoded"))


@query("p12_scripts", r"""
SELECT doc_id, regexp_matches(text, '[a-zA-Z]')::INT + regexp_matches(text, '[\x{0400}-\x{04FF}]')::INT + regexp_matches(text, '[\x{0370}-\x{03FF}]')::INT
  + regexp_matches(text, '[\x{0530}-\x{058F}]')::INT + regexp_matches(text, '[\x{0600}-\x{06FF}]')::INT + regexp_matches(text, '[\x{0E00}-\x{0E7F}]')::INT
  + regexp_matches(text, '[\x{0E80}-\x{0EFF}]')::INT + regexp_matches(text, '[\x{1000}-\x{109F}]')::INT AS scripts,
  round(1 - len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) / strlen(text), 6) AS printable FROM documents""")
def _(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", text.script_count(t).alias("scripts"), F.round(text.printable_ratio(t), 6).alias("printable"))


ENTROPY_SQL = """bytes AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
bx AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM bytes)),
bc AS (SELECT doc_id, b, count(*) AS c FROM bx GROUP BY 1, 2), bt AS (SELECT doc_id, sum(c) AS t FROM bc GROUP BY 1),
ent AS (SELECT doc_id, -sum(c / t * log2(c / t)) AS entropy FROM bc JOIN bt USING (doc_id) GROUP BY 1)"""


@query("p13_feature_vector", rf"""
WITH {ENTROPY_SQL}, p AS (SELECT d.*, entropy, strlen(text) AS n FROM documents d JOIN ent USING (doc_id))
SELECT doc_id, round(least(1.0, n / 4096), 5) AS payload_length, round(least(1.0, length(lang) / 20), 5) AS param_count, round(least(1.0, entropy / 8), 5) AS entropy,
  round(round(len(regexp_extract_all(text, '[<>"'';%|&`$(){{}}\\/*#=?!\[\]]')) / n * 100, 2) / 100, 5) AS special_ratio,
  round(len(regexp_extract_all(text, '[0-9]')) / n, 5) AS numeric_ratio, round(len(regexp_extract_all(text, '[A-Z]')) / n, 5) AS uppercase_ratio,
  round((n - len(regexp_extract_all(text, '[\x00-\x7F]'))) / n, 5) AS non_ascii_ratio, 0.1::DOUBLE AS url_depth, 0.1::DOUBLE AS path_segments,
  round(least(1.0, length(lang) / 20), 5) AS query_params, round(least(1.0, (doc_id % 101) / 100), 5) AS risk,
  round(least(1.0, regexp_matches(text, '%[0-9a-fA-F]{{2}}')::INT / 3.0), 5) AS encoding_depth FROM p""")
def _(spark, d):
    f = text.feature_vector(F.col("text"), F.concat(F.lit("/"), "source"), F.length("lang"), F.col("doc_id") % 101, text.byte_entropy(F.col("text")))
    return documents(spark, d).select("doc_id", *[F.round(c, 5).alias(n) for n, c in f.items()])


def _features_sql() -> str:
    def cls(chars):
        return "[" + "".join("\\" + c if c in "\\[]^-/()|;'\"<>=" and c not in ";'\"<>=/" else c for c in chars) + "]"

    n = "greatest(strlen(text), 1)"
    cols = ["strlen(text) AS length", rf"round(strlen(regexp_replace(text, '[a-zA-Z0-9\s]', '', 'g')) / {n}, 6) AS special_ratio"]
    cols += [f"len(regexp_extract_all(text, {sql_text(cls(c))})) AS {k}" for k, c in text.COUNTED_CHARS.items()]
    cols += [f"round(len(regexp_extract_all(text, ' ')) / {n}, 6) AS space_ratio"]
    cols += [f"len(regexp_extract_all(text, {sql_text(p)})) AS {k}" for k, p in text.COUNTED_PATTERNS.items()]
    cols += [f"CAST(regexp_matches(text, {sql_text(p)}) AS INT) AS {k}" for k, p in text.FLAG_PATTERNS.items()]
    cols += [f"round(len(regexp_extract_all(text, {sql_text(text.DENSE_WORDS)})) / {n} * 100, 6) AS keyword_density"]
    t = "trim(text)"
    cols += [f"CAST(strlen({t}) >= 20 AND regexp_matches({t}, '^[A-Za-z0-9+/=]+$') AND strlen({t}) % 4 = 0 AS INT) AS base64_like",
             f"CAST(strlen({t}) >= 10 AND regexp_matches({t}, '^[0-9a-fA-F]+$') AS INT) AS hex_like"]
    return ", ".join(cols)


@query("p14_structural_features", f"SELECT page_id, {_features_sql()} FROM (SELECT page_id, html AS text FROM pages)")
def _(spark, d):
    f = text.structural_features(F.col("html"))
    return pages(spark, d).select("page_id", *[(F.round(c, 6) if n in text.RATIO_FEATURES else c).alias(n) for n, c in f.items()])


@query("p15_byte_entropy", f"WITH {ENTROPY_SQL} SELECT doc_id, round(entropy, 5) AS entropy FROM ent")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.round(text.byte_entropy(F.col("text")), 5).alias("entropy"))


@query("p15_count_entropy", f"""
WITH {EVENTS_SQL}, c AS (SELECT user_id, event_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM ev GROUP BY 1, 2)
SELECT user_id, round(-sum(c / t * log2(c / t)), 5) AS entropy FROM c GROUP BY 1""")
def _(spark, d):
    c = events(spark, d).groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.collect_list("count").alias("c"))
    return c.select("user_id", F.round(text.entropy_of_counts(F.col("c")), 5).alias("entropy"))


@query("p16_ordinary_discount", rf"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS x FROM documents), n AS (SELECT *, strlen(x) AS n FROM w WHERE x <> ''),
s AS (SELECT doc_id, (regexp_matches(x, '^[A-Za-z0-9+/=]+$') AND n % 4 = 0 AND n - strlen(replace(x, '=', '')) <= 2)::INT * 30 + regexp_matches(x, '^\d+$')::INT * 40
  + regexp_matches(x, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+$')::INT * 25 + regexp_matches(x, '^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)$')::INT * 35
  + regexp_matches(x, '^\d{{4}}[-/]\d{{2}}[-/]\d{{2}}$')::INT * 30 + (len(regexp_extract_all(x, '[\x{{4E00}}-\x{{9FFF}}]')) / n > 0.3)::INT * 15
  + regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/?#]+[^\s]*$')::INT * 20 AS discount FROM n)
SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE discount > 0) AS ordinary, sum(discount)::BIGINT AS discount, max(discount)::BIGINT AS most FROM s GROUP BY 1""")
def _(spark, d):
    # Every word of every text.
    words = documents(spark, d).select("doc_id", F.explode(F.split("text", r"\s+")).alias("x")).filter("x <> ''")
    each = words.select("doc_id", text.ordinary_discount(F.col("x")).cast("bigint").alias("x"))
    return each.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(F.col("x") > 0).alias("ordinary"), F.sum("x").alias("discount"), F.max("x").alias("most"))


@query("p19_segment_and_number", """
WITH i AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'fe80:' || page_id || '::1' WHEN page_id % 7 = 0 THEN 'not-an-ip'
  ELSE page_id % 256 || '.' || page_id % 100 || '.' || page_id % 10 || '.' || page_id % 200 END AS ip FROM pages)
SELECT page_id, CASE WHEN ip LIKE 'fe80%' THEN 'fe80:' || page_id WHEN ip = 'not-an-ip' THEN '' ELSE page_id % 256 || '.' || page_id % 100 || '.' || page_id % 10 END AS segment,
  CASE WHEN ip LIKE '%.%' THEN ((page_id % 256 * 256 + page_id % 100) * 256 + page_id % 10) * 256 + page_id % 200 END AS number FROM i""")
def _(spark, d):
    i = F.col("page_id")
    quad = F.concat_ws(".", *[(i % m).cast("string") for m in (256, 100, 10, 200)])
    ip = first_of([(i % 5 == 0, F.concat(F.lit("fe80:"), i.cast("string"), F.lit("::1"))), (i % 7 == 0, "not-an-ip")], quad)
    p = pages(spark, d).withColumn("ip", ip)
    return p.select("page_id", net.ip_segment(F.col("ip")).alias("segment"), net.ip_number(F.col("ip")).alias("number"))


STORED_SQL = """CASE doc_id % 7 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) WHEN 2 THEN sha256(text) WHEN 3 THEN '$2y$12$' || md5(text)
  WHEN 4 THEN '$P$' || md5(text) WHEN 5 THEN '$argon2id$' || md5(text) ELSE text END"""


def stored(spark, d):
    i, t = F.col("doc_id") % 7, F.col("text")
    h = first_of([(i == 0, F.md5(t)), (i == 1, F.sha1(t)), (i == 2, F.sha2(t, 256)), (i == 3, F.concat(F.lit("$2y$12$"), F.md5(t))),
                  (i == 4, F.concat(F.lit("$P$"), F.md5(t))), (i == 5, F.concat(F.lit("$argon2id$"), F.md5(t)))], t)
    return documents(spark, d).withColumn("stored", h)


@query("p20_credential_format", """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' WHEN 2 THEN 'sha256' WHEN 3 THEN 'bcrypt' WHEN 4 THEN 'phpass' WHEN 5 THEN 'argon2id'
  ELSE CASE WHEN text = '' THEN 'empty' ELSE 'unknown' END END AS format FROM documents""")
def _(spark, d):
    return stored(spark, d).select("doc_id", audit.credential_format(F.col("stored")).alias("format"))


@query("p21_session_id_weakness", r"""
WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN 'admin-' || event_id ELSE md5(props) END AS s FROM events)
SELECT event_id, greatest(CASE WHEN strlen(s) < 10 THEN 65 WHEN strlen(s) < 16 THEN 40 ELSE 0 END, CASE WHEN s LIKE 'admin-%' THEN 80 ELSE 0 END,
  CASE WHEN regexp_matches(s, '^[0-9]{1,6}$') THEN 75 ELSE 0 END, CASE WHEN regexp_matches(s, '^[a-z]{1,10}$') THEN 70 ELSE 0 END) AS weakness FROM c""")
def _(spark, d):
    i = F.col("event_id")
    s = first_of([(i % 4 == 0, i.cast("string")), (i % 4 == 1, F.col("event_type")), (i % 4 == 2, F.concat(F.lit("admin-"), i.cast("string")))], F.md5("props"))
    return events(spark, d).select("event_id", audit.session_id_weakness(s).alias("weakness"))


@query("p22_structure_score", rf"""
WITH {PAIRS_SQL}, p AS (SELECT page_id, string_agg(value, ' ') AS v, count(*) FILTER (WHERE contains(name, 'file') OR contains(name, 'url') OR contains(name, 'code')) AS odd FROM qp GROUP BY 1),
j AS (SELECT page_id, url, coalesce(v, '') AS v, coalesce(odd, 0) AS odd FROM pages LEFT JOIN p USING (page_id)), r AS (SELECT *, greatest(strlen(v), 1) AS n FROM j)
SELECT page_id, CAST(least(100, (strlen(url) > 200)::INT * 15 + (length(url) - length(replace(url, '/', '')) > 8)::INT * 10 + contains(url, '../')::INT * 20
  + regexp_matches(url, '(?i)\.(?:php|asp|jsp|cgi|env|sql)$')::INT * 10 + regexp_matches(url, '(?i)(?:union|select|concat|script|onerror|javascript:)')::INT * 25
  + (strlen(regexp_replace(v, '[^A-Z]', '', 'g')) / n > 0.5 AND strlen(regexp_replace(v, '[^0-9]', '', 'g')) / n > 0.3)::INT * 15
  + (strlen(v) > 0 AND strlen(regexp_replace(v, '[a-zA-Z0-9\s]', '', 'g')) / n > 0.4)::INT * 15 + odd * 8) AS BIGINT) AS score FROM r""")
def _(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", uri.structure_score(u, uri.query_pairs(u)).cast("bigint").alias("score"))


def _headers(spark, d):
    i = F.col("page_id")
    pairs = [("host", "www.example.org"), ("referer", F.col("url")), ("origin", first_of([(i % 3 == 0, "https://www.example.org"), (i % 3 == 1, F.concat(
        F.lit("https://"), uri.host_of(F.col("url"))))], "")), ("x-csrf-token", F.when(i % 4 == 0, "t").otherwise("")),
        ("content-length", first_of([(i % 5 == 0, "12, 13"), (i % 5 == 1, "abc")], "12")), ("transfer-encoding", F.when(i % 7 == 0, "chunked"))]
    m = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), (v if not isinstance(v, str) else F.lit(v)).alias("v")) for k, v in pairs]),
                                    lambda e: e["v"].isNotNull()))
    return pages(spark, d).withColumn("headers", m)


@query("p23_cross_site_risk", r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS rh, page_id % 2 = 0 AS post FROM pages),
o AS (SELECT *, CASE page_id % 3 WHEN 0 THEN 'www.example.org' WHEN 1 THEN rh ELSE '' END AS oh FROM h)
SELECT page_id, CAST((oh <> '' AND oh <> rh)::INT * 30 + (oh <> '' AND oh <> 'www.example.org')::INT * 25 + (post AND page_id % 4 <> 0)::INT * 15 AS BIGINT) AS risk FROM o""")
def _(spark, d):
    m = F.when(F.col("page_id") % 2 == 0, "POST").otherwise("GET")
    return _headers(spark, d).select("page_id", audit.cross_site_risk(m, F.col("headers")).cast("bigint").alias("risk"))


@query("p24_token_audit", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'alg_none' WHEN 1 THEN 'no_expiry' WHEN 2 THEN 'expired' WHEN 3 THEN 'unsigned' WHEN 4 THEN 'not_yet_valid' END AS token_issue FROM events""")
def _(spark, d):
    i = F.col("event_id") % 6

    def part(j):
        return F.translate(F.regexp_replace(F.base64(F.encode(j, "utf-8")), "=|\\s", ""), "+/", "-_")

    head = part(F.when(i == 0, '{"alg":"none","typ":"JWT"}').otherwise('{"alg":"HS256","typ":"JWT"}'))
    body = part(first_of([(i == 1, F.format_string('{"sub":"%d"}', F.col("event_id"))), (i == 2, '{"exp":100}'), (i == 4, '{"exp":9000000,"nbf":8000000}')],
                         F.format_string('{"exp":9000000,"sub":"%d"}', F.col("event_id"))))
    tok = F.when(i == 3, F.concat_ws(".", head, body)).otherwise(F.concat_ws(".", head, body, F.sha2("props", 256)))
    return audit.token_audit(events(spark, d).withColumn("token", tok), "token", F.lit(5_000_000)).select("event_id", "token_issue")


@query("p25_smuggling", """
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'length_and_chunked' WHEN page_id % 5 = 0 THEN 'several_lengths' WHEN page_id % 5 = 1 THEN 'bad_length' END AS issue FROM pages""")
def _(spark, d):
    return _headers(spark, d).select("page_id", audit.smuggling_issue(F.col("headers")).alias("issue"))


# Payload of a page taken as a request: its text, decoding depth of the url, kinds of encoding, entropy.
DEPTH_SQL = "e0 AS (SELECT page_id, coalesce(url, '') AS u, 0 AS d FROM pages), " + ", ".join(
    f"e{i} AS (SELECT page_id, url_decode(replace(u, '+', '%2B')) AS u, d + (url_decode(replace(u, '+', '%2B')) <> u)::INT AS d FROM e{i - 1})" for i in range(1, 13))
PAYLOAD_SQL = rf"""pl AS (SELECT page_id, concat_ws(' ', nullif(url, ''), nullif(html, '')) AS x FROM pages), {DEPTH_SQL}, hb AS (SELECT page_id, hex(encode(x)) AS h FROM pl),
bc AS (SELECT page_id, b, count(*) AS c FROM (SELECT page_id, substr(h, 2 * i + 1, 2) AS b FROM (SELECT page_id, h, unnest(range(length(h) // 2)) AS i FROM hb)) GROUP BY 1, 2),
en AS (SELECT page_id, -sum(c / t * log2(c / t)) AS e FROM bc JOIN (SELECT page_id, sum(c) AS t FROM bc GROUP BY 1) USING (page_id) GROUP BY 1),
s AS (SELECT page_id, x, d AS dp, {' + '.join(f"regexp_matches(x, {sql_text(p)})::INT" for p in verdict.ENCODINGS.values())} AS kinds, d >= 2 AS dbl, e FROM pl JOIN e12 USING (page_id) JOIN en USING (page_id))"""
# Continues ``s`` (page_id, x, dp, kinds, dbl, e).
OBFUSCATION_SQL = rf"""c AS (SELECT *, regexp_matches(x, '[a-zA-Z]')::INT + regexp_matches(x, '[\x{{0400}}-\x{{04FF}}]')::INT + regexp_matches(x, '[\x{{0370}}-\x{{03FF}}]')::INT + regexp_matches(x, '[\x{{0530}}-\x{{058F}}]')::INT
    + regexp_matches(x, '[\x{{0600}}-\x{{06FF}}]')::INT + regexp_matches(x, '[\x{{4E00}}-\x{{9FFF}}]')::INT AS mixed,
  len(regexp_extract_all(x, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}\x{{2060}}\x{{00AD}}\x{{202A}}-\x{{202E}}]')) AS inv,
  len(regexp_extract_all(x, '/\*[\s\S]*?\*/')) + len(regexp_extract_all(x, '<!--[\s\S]*?-->')) AS com, len(regexp_extract_all(x, '[A-Z]')) AS up, len(regexp_extract_all(x, '[a-z]')) AS lo,
  len(regexp_extract_all(x, '[\x{{0370}}-\x{{04FF}}]')) AS alien, len(regexp_extract_all(x, '0x[0-9a-fA-F]{{4,}}')) + len(regexp_extract_all(x, '\\x[0-9a-fA-F]{{2}}')) AS hx,
  1 - strlen(regexp_replace(x, '\s+', '', 'g')) / strlen(x) AS ws, strlen(x) AS n,
  regexp_matches(x, '\.\s*\$')::INT + regexp_matches(x, '\$\w+\s*\.\s*["'']')::INT + regexp_matches(x, '["'']\s*\.\s*\$')::INT + regexp_matches(x, '(?i)concat\s*\(')::INT
    + regexp_matches(x, '(?i)group_concat\s*\(')::INT AS cat FROM s),
f AS (SELECT *, up + lo > 10 AND alien > 0 AS look, up + lo > 20 AND up / (up + lo) > 0.3 AND up / (up + lo) < 0.7 AS cas FROM c),
g AS (SELECT *, CASE WHEN dp >= 4 THEN 30 WHEN dp >= 2 THEN 15 ELSE 0 END + CASE WHEN kinds >= 4 THEN 15 WHEN kinds >= 2 THEN 8 ELSE 0 END + dbl::INT * 25
  + CASE WHEN mixed >= 3 THEN 20 WHEN mixed >= 2 THEN 10 ELSE 0 END + look::INT * 15 + CASE WHEN inv >= 5 THEN 15 WHEN inv >= 1 THEN 8 ELSE 0 END
  + CASE WHEN com >= 3 THEN 12 WHEN com >= 1 THEN 5 ELSE 0 END + cas::INT * 5 + (ws > 0.3)::INT * 8 + CASE WHEN hx >= 3 THEN 18 WHEN hx >= 1 THEN 8 ELSE 0 END
  + CASE WHEN cat >= 2 THEN 15 WHEN cat >= 1 THEN 8 ELSE 0 END + (e > 5.5 AND n > 30)::INT * 10 AS raw,
  concat_ws(',', CASE WHEN dp >= 2 THEN 'encoding_multilayer' END, CASE WHEN kinds >= 4 THEN 'encoding_diversity' END, CASE WHEN dbl THEN 'double_encoding' END,
    CASE WHEN mixed >= 3 OR look THEN 'homoglyph' END, CASE WHEN inv >= 5 THEN 'invisible_chars' END, CASE WHEN com >= 3 THEN 'comment_injection' END, CASE WHEN cas THEN 'case_mixing' END,
    CASE WHEN ws > 0.3 THEN 'whitespace_injection' END, CASE WHEN hx >= 3 THEN 'hex_obfuscation' END, CASE WHEN cat >= 2 THEN 'string_concat' END) AS techniques,
  (dp >= 2)::INT + dbl::INT + (mixed >= 3 OR look)::INT AS risky FROM f),
h AS (SELECT *, least(100, raw) AS s, CASE WHEN techniques = '' THEN 0 ELSE len(string_split(techniques, ',')) END AS nt FROM g)
SELECT page_id, CAST(s AS BIGINT) AS obfuscation, CASE WHEN s >= 70 THEN 'extreme' WHEN s >= 50 THEN 'heavy' WHEN s >= 30 THEN 'moderate' WHEN s >= 10 THEN 'light' ELSE 'none' END AS obfuscation_depth,
  techniques, CAST(least(100, risky * 20 + CASE WHEN nt >= 4 THEN 20 ELSE 0 END) AS BIGINT) AS bypass_intent FROM h"""


@query("p26_obfuscation", f"WITH {PAYLOAD_SQL}, {OBFUSCATION_SQL}")
def _(spark, d):
    r = verdict.payloads(pages(spark, d), "page_id", "url", "html")
    return r.select("page_id", "obfuscation", "obfuscation_depth", F.concat_ws(",", "techniques").alias("techniques"), "bypass_intent")


@query("p27_parameter_profile", f"""
WITH {PAIRS_SQL}, a AS (SELECT regexp_extract(url, '://([^/?#:]*)', 1) AS host, name, value FROM qp),
c AS (SELECT *, CASE name WHEN 'page' THEN 'numeric' WHEN 'ref' THEN 'redirect' ELSE 'unknown' END AS category,
  CASE WHEN regexp_matches(value, '^-?[0-9]+$') THEN 'numeric' ELSE 'text' END AS type FROM a)
SELECT host, name, category, type, count(*) AS n, count(*) FILTER (WHERE category = 'numeric' AND type <> 'numeric') AS mismatches FROM c GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    p = pr.url_params(pages(spark, d).withColumn("host", uri.host_of(F.col("url"))), ["host"], "url")
    return pr.parameter_profile(p, ["host"])


@query("f1_static_exclusion", rf"SELECT page_id FROM pages WHERE NOT regexp_matches({PATH}, '\.(?:html|css)$')")
def _(spark, d):
    return pages(spark, d).filter(~uri.is_static(uri.path_of(F.col("url")), ["html", "css"])).select("page_id")


AS_OF = "2024-01-20"


@query("f2_trailing_days", f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE CAST(ts AS DATE) > DATE '{AS_OF}' - 7 AND CAST(ts AS DATE) <= DATE '{AS_OF}'")
def _(spark, d):
    day = F.to_date("ts")
    as_of = F.lit(AS_OF).cast("date")
    return events(spark, d).filter((day > F.date_sub(as_of, 7)) & (day <= as_of)).select("event_id")


@query("f3_unexpired", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0 OR epoch(o_orderdate) + 86400 * (o_custkey % 400) > epoch(TIMESTAMP '1996-01-01')")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("expire", F.when(F.col("o_custkey") % 10 == 0, 0).otherwise(
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 86400 * (F.col("o_custkey") % 400)))
    return o.filter((F.col("expire") == 0) | (F.col("expire") > F.unix_timestamp(F.lit("1996-01-01 00:00:00").cast("timestamp")))).select("o_orderkey")


@query("f4_url_allowlist", rf"""
SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 50 = 0) AND NOT starts_with(url, 'https://www.') AND NOT regexp_matches(url, '/de/\d+$')""")
def _(spark, d):
    p = pages(spark, d)
    exact = p.filter(F.col("page_id") % 50 == 0).select("url")
    return url_allowlist(p, "url", exact, ["https://www."], [r"/de/\d+$"]).select("page_id")


@query("f5_admissible", f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE event_type <> 'purchase' AND k % 3 <> 2")
def _(spark, d):
    t = F.when(F.col("event_type") == "purchase", "DELETE").otherwise("POST")
    ct = first_of([(F.col("k") % 3 == 0, "Application/JSON; charset=utf-8"), (F.col("k") % 3 == 2, "image/png")], None)
    return events(spark, d).filter(audit.admissible(t, ct)).select("event_id")


@query("f6_repeated_names", f"WITH {PAIRS_SQL} SELECT page_id FROM qp GROUP BY page_id HAVING count(*) > 1")
def _(spark, d):
    # All names are made equal first, since the given URLs repeat none.
    u = F.regexp_replace("url", r"([?&])[a-z_]+=", "$1x=")
    return pages(spark, d).filter(pr.repeated_names(u)).select("page_id")


@query("f7_malformed_address", r"""
SELECT event_id, CASE WHEN k % 4 = 0 THEN 'UNKNOWN' WHEN k % 4 = 1 THEN 'LOCAL' ELSE 'OTHER' END AS place FROM (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def _(spark, d):
    k = F.col("k").cast("string")
    ip = first_of([(F.col("k") % 4 == 0, F.concat(F.lit("999.1.1."), k)), (F.col("k") % 4 == 1, F.concat(F.lit("10.0.0."), k))], F.concat(F.lit("8.8.8."), k))
    n = net.ip_number(ip)
    return events(spark, d).select("event_id", first_of([(n.isNull(), "UNKNOWN"), (net.in_blocks(n, net.LOCAL_BLOCKS), "LOCAL")], "OTHER").alias("place"))


@query("f9_trusted_names", f"""
WITH {PAIRS_SQL}, n AS (SELECT page_id, count(*) AS c, count(*) FILTER (WHERE name IN ('page', 'ref')) AS t FROM qp GROUP BY 1)
SELECT page_id, round(coalesce(t / c, 0), 4) AS share FROM pages LEFT JOIN n USING (page_id)""")
def _(spark, d):
    names = F.transform(uri.query_pairs(F.col("url")), lambda p: p["name"])
    return pages(spark, d).select("page_id", F.round(pr.trusted_share(names, ["page", "ref"]), 4).alias("share"))


@query("j5_position_threats", f"""
WITH {PAIRS_SQL}, r(rule_name, position, threat, weight) AS (VALUES {values_sql([('page', 'query', 'idor', 1.2), ('source', 'query', 'spoof', 1.3), ('utm', 'query', 'tracking', 1.0)])})
SELECT page_id, name, CASE name WHEN 'page' THEN 'idor' WHEN 'utm_source' THEN 'spoof' END AS threat, CAST(CASE name WHEN 'page' THEN 24 WHEN 'utm_source' THEN 26 END AS BIGINT) AS risk
FROM qp WHERE name IN ('page', 'utm_source')""")
def _(spark, d):
    rules = spark.createDataFrame([("page", "query", "idor", 1.2), ("source", "query", "spoof", 1.3), ("utm", "query", "tracking", 1.0)],
                                  "rule_name string, position string, threat string, weight double")
    return pr.position_threats(pr.url_params(pages(spark, d), ["page_id"], "url"), rules).select("page_id", "name", "threat", "risk")


@query("j19_cross_position", f"""
WITH {EVENTS_SQL}, p AS (SELECT user_id, event_type, 'query' AS position, k % 3 AS v FROM ev UNION ALL SELECT user_id, event_type, 'cookie', k % 2 FROM ev WHERE k > 50)
SELECT user_id, event_type AS name, count(DISTINCT position) AS positions, count(DISTINCT v) AS "values", CAST(10 + CASE WHEN count(DISTINCT v) > 1 THEN 15 ELSE 0 END AS BIGINT) AS score
FROM p GROUP BY 1, 2 HAVING count(DISTINCT position) >= 2""")
def _(spark, d):
    e = events(spark, d)

    def one(pos, m, df):
        return df.select("user_id", F.col("event_type").alias("name"), F.lit(pos).alias("position"), (F.col("k") % m).alias("value"))

    return pr.cross_position(one("query", 3, e).unionByName(one("cookie", 2, e.filter("k > 50"))), ["user_id"])


@query("a34_consecutive_ids", f"""
WITH {EVENTS_SQL}, v AS (SELECT DISTINCT user_id, k + 99950 AS k FROM ev), g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS grp FROM v),
c AS (SELECT user_id, grp, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, max(n) AS longest_run,
  CAST(CASE WHEN max(n) >= 5 THEN 70 WHEN max(n) >= 3 THEN 45 ELSE 0 END AS BIGINT) AS score FROM c GROUP BY 1""")
def _(spark, d):
    p = events(spark, d).select("user_id", (F.col("k") + 99950).cast("string").alias("value"))
    return pr.consecutive_ids(p, ["user_id"])


@query("a35_enumeration", f"""
WITH {EVENTS_SQL}, v AS (SELECT DISTINCT user_id, event_type AS name, CASE WHEN event_type = 'view' THEN 'u' || k % 12 ELSE CAST(k % 4 AS VARCHAR) END AS value FROM ev)
SELECT user_id, name, count(*) AS distinct_values, bool_and(try_cast(value AS DOUBLE) IS NOT NULL) AS numeric, round(stddev_pop(strlen(value)), 4) AS length_sd,
  count(*) >= 3 AND bool_and(try_cast(value AS DOUBLE) IS NOT NULL) OR count(*) >= 5 AND stddev_pop(strlen(value)) < 2 AS enumerated FROM v GROUP BY 1, 2""")
def _(spark, d):
    v = F.when(F.col("event_type") == "view", F.concat(F.lit("u"), (F.col("k") % 12).cast("string"))).otherwise((F.col("k") % 4).cast("string"))
    p = events(spark, d).select("user_id", F.col("event_type").alias("name"), v.alias("value"))
    return pr.enumeration(p, ["user_id"]).withColumn("length_sd", F.round("length_sd", 4))


@query("a36_payload_evolution", """
WITH v AS (SELECT DISTINCT source, lang, 'text' AS name, text AS value FROM documents)
SELECT source, lang, name, count(*) AS distinct_values, count(*) FILTER (WHERE contains(lower(value), 'ou') OR contains(lower(value), 'des')) AS worded,
  count(*) FILTER (WHERE contains(value, '##') OR contains(value, '**')) AS disguised,
  count(*) FILTER (WHERE contains(lower(value), 'ou') OR contains(lower(value), 'des')) >= 2 AND count(*) FILTER (WHERE contains(value, '##') OR contains(value, '**')) >= 1 AS evolving
FROM v GROUP BY 1, 2, 3""")
def _(spark, d):
    p = documents(spark, d).select("source", "lang", F.lit("text").alias("name"), F.col("text").alias("value"))
    return pr.payload_evolution(p, ["source"], "lang", ["ou", "des"], ["##", "**"])
