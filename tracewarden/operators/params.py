"""Request parameters in long form: explode, categories, positions, enumeration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of, points
from tracewarden.functions.text import java_regex
from tracewarden.functions.uri import query_pairs

PAIR = "array<struct<name:string,value:string>>"


def json_params(doc: Column) -> Column:
    """(name, value) pairs of a JSON object, nested names joined by dots, at any depth."""

    def entries(text: Column) -> Column:
        obj = F.transform(F.map_entries(F.from_json(text, "map<string,string>")),
                          lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
        arr = F.transform(F.from_json(text, "array<string>"), lambda v, i: F.struct(i.cast("string").alias("name"), v.alias("value")))
        return F.when(text.startswith("{"), obj).when(text.startswith("["), arr)

    out = F.coalesce(entries(F.trim(doc)), F.array().cast(PAIR))

    def deeper(pairs: Column) -> Column:
        return F.flatten(F.transform(pairs, lambda p: F.coalesce(
            F.transform(entries(p["value"]), lambda q: F.struct(
                F.concat_ws(".", p["name"], q["name"]).alias("name"), q["value"].alias("value"))),
            F.array(p)))).cast(PAIR)

    def nested(pairs: Column) -> Column:
        return F.exists(pairs, lambda p: F.coalesce(p["value"].startswith("{") | p["value"].startswith("["), F.lit(False)))

    # each level takes a bracket of the text, escaped ones included; nothing happens once no value is nested
    levels = F.coalesce(F.regexp_count(doc, F.lit(r"[{\[]|u00")), F.lit(0))
    steps = F.when(nested(out), F.sequence(F.lit(1), F.greatest(levels, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, out.cast(PAIR), lambda pairs, _: F.when(nested(pairs), deeper(pairs)).otherwise(pairs))


def explode_params(df: DataFrame, id_cols, sources: dict[str, Column]) -> DataFrame:
    """Long table (ids, position, name, value) from (name, value) arrays by position."""

    def tag(position: str, pairs: Column) -> Column:
        return F.transform(pairs, lambda p: F.struct(F.lit(position).alias("position"), p["name"].alias("name"), p["value"].alias("value")))

    tagged = [tag(position, pairs) for position, pairs in sources.items()]
    return df.select(*id_cols, F.explode(F.concat(*tagged) if len(tagged) > 1 else tagged[0]).alias("p")).select(*id_cols, "p.*")


def url_params(df: DataFrame, id_cols, uri: str) -> DataFrame:
    return explode_params(df, id_cols, {"query": query_pairs(F.col(uri))})


# Category by name token.
NAME_ROOTS = {
    "identifier": ["id", "uid", "gid", "pid", "cid", "aid", "fid", "tid", "nid", "rid", "sid", "eid", "oid"],
    "numeric": ["page", "p", "limit", "offset", "size", "count", "num", "number", "qty", "quantity", "amount", "total", "index", "pos", "per"],
    "name": ["name", "username", "user", "uname", "login", "account", "author", "nickname", "nick"],
    "search": ["q", "query", "keyword", "keywords", "kw", "search", "term", "terms", "k"],
    "content": ["content", "body", "text", "message", "msg", "comment", "desc", "description", "detail", "bio", "about", "title",
                "subject", "topic", "summary"],
    "action": ["action", "cmd", "command", "op", "do", "task", "method", "func", "function"],
    "flag": ["type", "t", "category", "cat", "tag", "tags", "status", "state", "level", "mode", "enabled", "disabled", "active",
             "checked", "selected", "remember", "agree", "subscribe", "verified"],
    "credential": ["password", "passwd", "pwd", "pass", "token", "secret", "apikey", "key", "signature", "sign", "hash", "captcha"],
    "contact": ["email", "mail", "phone", "tel", "mobile", "url", "website", "ip", "address"],
    "file": ["file", "upload", "attachment", "avatar", "image", "img", "logo", "pic", "photo"],
    "redirect": ["redirect", "redirect_to", "return", "returnurl", "returnto", "next", "callback", "target", "to", "ref", "referer",
                 "origin", "forward", "goto"],
    "date": ["date", "time", "start", "end", "begin", "expire", "expiry", "from", "created", "updated", "timestamp"],
}
# What values a category expects.
EXPECTED = {"identifier": "numeric", "numeric": "numeric", "flag": "enum", "action": "word", "name": "word", "search": "freetext",
            "content": "freetext", "contact": "format", "file": "filename", "redirect": "path", "credential": "freetext", "date": "date"}
ENUM_VALUES = ["0", "1", "true", "false", "yes", "no", "on", "off", "enabled", "disabled", "active", "inactive", "checked",
               "unchecked", "y", "n"]
BOOLEANS = ["true", "false", "1", "0", "yes", "no", "on", "off", "y", "n", "enabled", "disabled", "active", "inactive"]
SQL_WORDS = ["select", "union", "insert", "update", "delete", "drop", "alter", "create", "truncate", "from", "where", "into", "table",
             "database", "schema", "or", "and", "not", "null", "having", "group", "order", "by", "limit", "concat", "substring",
             "substr", "benchmark", "sleep", "waitfor", "load_file", "outfile", "dumpfile", "exec", "execute", "declare", "cast",
             "convert", "like", "between", "exists", "case", "when", "distinct", "as", "join", "values", "set", "count", "char", "ascii",
             "hex", "if", "ifnull", "version", "extractvalue", "updatexml", "information_schema", "mysql", "sysobjects",
             "xp_cmdshell", "admin"]
BAD_SCHEMES = ["javascript:", "vbscript:", "data:", "file:", "php:", "expect:", "phar:", "zip:", "ssh2:", "gopher:", "dict:", "ldap:"]


def name_tokens(name: Column) -> Column:
    """Lower-case tokens of a name, cut at _ - . and where capitals start."""
    cut = F.regexp_replace(name, "(?<=[^A-Z_.\\-])(?=[A-Z])", "_")
    return F.filter(F.split(F.lower(cut), r"[_.\-]"), lambda t: t != "")


def _root(token: Column) -> Column:
    flat = F.create_map(*[x for cat, ws in NAME_ROOTS.items() for w in ws for x in (F.lit(w), F.lit(cat))])
    return F.try_element_at(flat, token)


def name_category(name: Column) -> Column:
    """Category of the whole name, else of its last token, else of its first known one."""
    toks = name_tokens(name)
    first_known = F.get(F.filter(F.transform(toks, _root), lambda r: r.isNotNull()), F.lit(0))
    return F.coalesce(_root(F.lower(name)), _root(F.try_element_at(toks, F.lit(-1))), first_known, F.lit("unknown"))


def value_type(value: Column) -> Column:
    """Type of a value from its shape; the dangerous ones first."""
    low = F.lower(value)
    sql_word = low.rlike(java_regex(r"\b(?:" + "|".join(SQL_WORDS) + r")\b"))
    is_sql = sql_word & (value.rlike("['\"`=]") | value.rlike(java_regex(r"(?i)\b(?:or|and|union|select)\b")))
    scheme = F.lit(False)
    for s in BAD_SCHEMES:
        scheme = scheme | low.startswith(s)
    angles = F.length(value) - F.length(F.translate(value, "<>", ""))
    json = (value.rlike(r"(?s)^\{.*\}$") & F.from_json(value, "map<string,string>").isNotNull()) \
        | (value.rlike(r"(?s)^\[.*\]$") & F.from_json(value, "array<string>").isNotNull())
    return first_of([
        (value == "", "empty"), (value.rlike(r"^-?\d+(?:\.\d+)?$"), "numeric"), (low.isin(*BOOLEANS), "boolean"),
        (F.contains(value, F.lit("../")) | F.contains(value, F.lit("..\\")), "traversal"), (scheme, "danger_protocol"), (is_sql, "sql"),
        (value.rlike(r"[;|&`]\s*[a-zA-Z$_(]") | F.contains(value, F.lit("$(")), "command"), ((angles >= 2) & value.rlike("<[a-zA-Z/]"), "html"),
        (json, "json"), (value.rlike(r"^[^@\s]{1,64}@[^@\s]{1,64}\.[^@\s]{2,24}$"), "email"),
        (value.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]{1,32}://") | value.startswith("//"), "url"), (value.rlike(r"[/\\][a-zA-Z0-9_\-.]+"), "path")], "text")


def type_mismatch(category: Column, value: Column, kind: Column) -> Column:
    """Whether the value cannot be what a name of the category holds."""
    flat = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.lit(v))])
    expect = F.try_element_at(flat, category)
    code = value.rlike(r"[<>'\"`;|&$(){}\[\]\\]")
    date = value.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}|^\d{1,2}[-/]\d{1,2}[-/]\d{4}|^\d{10,13}$")
    return F.coalesce(first_of([
        (expect == "numeric", kind != "numeric"),
        (expect == "enum", (value != "") & ~F.lower(value).isin(*ENUM_VALUES) & ((F.octet_length(value) > 20) | code)),
        (expect == "word", code), (expect == "filename", (kind == "traversal") | value.rlike(r"[/\\]")), (expect == "path", kind == "danger_protocol"),
        (expect == "freetext", (category == "credential") & (kind == "sql")), (expect == "date", ~date & value.rlike(r"[<>'\"`;|&$]"))], F.lit(False)), F.lit(False))


def parameter_profile(params: DataFrame, group) -> DataFrame:
    """Counts per group and name: rows, category, value types, mismatches."""
    d = params.withColumn("category", name_category(F.col("name"))).withColumn("type", value_type(F.col("value")))
    d = d.withColumn("mismatch", type_mismatch(F.col("category"), F.col("value"), F.col("type")))
    return d.groupBy(*group, "name", "category", "type").agg(F.count("*").alias("n"), F.count_if("mismatch").alias("mismatches"))


# Threats by parameter name and position, (name, position, threat, weight).
POSITION_RULES = [
    ("id", "query", "idor", 1.2), ("id", "cookie", "session_manipulation", 1.5), ("id", "header", "injection", 1.3),
    ("redirect", "query", "open_redirect", 1.4), ("redirect", "post", "open_redirect", 1.3),
    ("url", "query", "ssrf", 1.5), ("url", "json", "ssrf", 1.4),
    ("file", "query", "path_traversal", 1.4), ("file", "post", "file_upload", 1.5),
    ("cmd", "query", "command_injection", 1.5), ("cmd", "post", "command_injection", 1.4),
    ("template", "query", "ssti", 1.5), ("template", "json", "ssti", 1.4),
    ("user-agent", "header", "xss_header_injection", 1.3), ("referer", "header", "xss_header_injection", 1.3),
    ("x-forwarded-for", "header", "ip_spoofing", 1.4),
    ("token", "cookie", "session_hijacking", 1.5), ("token", "header", "auth_bypass", 1.4),
    ("session", "cookie", "session_fixation", 1.5), ("q", "query", "sqli_xss", 1.2), ("search", "query", "sqli_xss", 1.2),
]


def position_threats(params: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of the parameter table with a rule for their name and position.

    ``rules`` is a table (rule_name, position, threat, weight) of any size. The exact name goes before
    name tokens, later tokens before earlier ones; of rules alike the first threat in order counts.
    Names are looked up once each, however many rows carry them.
    """
    names = F.concat(F.array(F.lower("name")), F.reverse(name_tokens(F.col("name"))))
    each = params.select("position", "name").distinct().select("position", "name", F.posexplode(names).alias("_i", "rule_name"))
    best = each.join(rules.select("position", "rule_name", "threat", "weight"), ["position", "rule_name"]).groupBy("position", "name").agg(F.min(F.struct("_i", "threat", "weight")).alias("_h"))
    return params.join(best, ["position", "name"]) \
        .withColumn("threat", F.col("_h.threat")).withColumn("risk", F.round(F.col("_h.weight") * 20).cast("bigint")).drop("_h")


def cross_position(params: DataFrame, request) -> DataFrame:
    """Names that a request uses in several positions, with points for differing values."""
    g = params.groupBy(*request, "name").agg(F.count_distinct("position").alias("positions"), F.count_distinct("value").alias("values"))
    return g.filter(F.col("positions") >= 2).withColumn("score", (10 + F.when(F.col("values") > 1, 15).otherwise(0)).cast("bigint"))


def consecutive_ids(params: DataFrame, key) -> DataFrame:
    """Longest run of consecutive whole numbers among the distinct ids of each key.

    Ids are cut into blocks of a fixed range, so a key with very many ids is worked on in
    pieces; runs are joined where they meet at block borders.
    """
    block = 100_000
    ids = params.select(*key, F.col("value").try_cast("bigint").alias("v")).filter(F.col("v").isNotNull()).distinct()
    ids = ids.withColumn("b", F.floor(F.col("v") / block).cast("bigint"))
    w = Window.partitionBy(*key, "b").orderBy("v")
    runs = ids.withColumn("g", F.col("v") - F.row_number().over(w)).groupBy(*key, "b", "g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edge = runs.filter((F.col("lo") == F.col("b") * block) | (F.col("hi") == F.col("b") * block + block - 1))
    ww = Window.partitionBy(*key).orderBy("lo")
    chained = edge.withColumn("new", F.when(F.col("lo") == F.lag("hi").over(ww) + 1, 0).otherwise(1)) \
        .withColumn("c", F.sum("new").over(ww.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chained.groupBy(*key, "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    inner = runs.filter((F.col("lo") != F.col("b") * block) & (F.col("hi") != F.col("b") * block + block - 1)).select(*key, "lo", "hi")
    d = inner.unionByName(joined.select(*key, "lo", "hi")).groupBy(*key).agg(F.max(F.col("hi") - F.col("lo") + 1).alias("longest_run"))
    return d.withColumn("score", first_of([(F.col("longest_run") >= 5, 70), (F.col("longest_run") >= 3, 45)], 0).cast("bigint"))


def enumeration(params: DataFrame, key) -> DataFrame:
    """Per key and name: distinct values, and whether they look enumerated."""
    d = params.select(*key, "name", "value").distinct()
    number = F.col("value").rlike(r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$")
    g = d.groupBy(*key, "name").agg(F.count("*").alias("distinct_values"), F.bool_and(number).alias("numeric"),
                                    F.stddev_pop(F.octet_length("value")).alias("length_sd"))
    return g.withColumn("enumerated", ((F.col("distinct_values") >= 3) & F.col("numeric"))
                        | ((F.col("distinct_values") >= 5) & (F.col("length_sd") < 2)))


# Words of attack texts, and marks of attempts to hide them.
EVOLUTION_WORDS = ["union", "select", "insert", "update", "delete", "drop", "script", "alert", "onerror", "onload", "eval", "exec",
                   "system", "passthru", "shell"]
EVOLUTION_MARKS = ["/*", "*/", "%20", "%09", "\\t", "\\n", "+", "--"]


def payload_evolution(params: DataFrame, key, endpoint: str, words=EVOLUTION_WORDS, marks=EVOLUTION_MARKS) -> DataFrame:
    """Same name and endpoint with several worded values, at least one of them disguised."""
    low = F.lower(F.col("value"))

    def any_of(items):
        hit = F.lit(False)
        for i in items:
            hit = hit | F.contains(low, F.lit(i))
        return hit

    d = params.select(*key, endpoint, "name", "value").distinct()
    g = d.groupBy(*key, endpoint, "name").agg(F.count("*").alias("distinct_values"), F.count_if(any_of(words)).alias("worded"),
                                              F.count_if(any_of(marks)).alias("disguised"))
    return g.withColumn("evolving", (F.col("worded") >= 2) & (F.col("disguised") >= 1))


def repeated_names(uri: Column) -> Column:
    """Whether the query string names a parameter twice."""
    names = F.transform(query_pairs(uri), lambda p: p["name"])
    return F.size(names) > F.size(F.array_distinct(names))


# Parameter names common in ordinary forms.
TRUSTED_NAMES = [
    "q", "query", "keyword", "search", "s", "url", "link", "redirect", "next", "return_url", "callback", "content", "body", "message",
    "text", "description", "comment", "code", "gist", "snippet", "paste", "script", "data", "json", "xml", "payload", "file",
    "file_name", "upload", "username", "email", "password", "captcha", "token", "title", "name", "tags", "category", "filters",
    "options", "settings", "config", "post_title", "post_content", "post_excerpt", "post_status", "post_author", "post_date",
    "post_category", "post_tags", "comment_content", "comment_author", "comment_author_email", "customized", "wp_customize",
    "customize_changeset_uuid", "action", "_ajax_nonce", "nonce", "_wpnonce", "meta", "meta_value", "meta_key", "attachment",
    "attachments", "file_upload", "widget", "sidebar", "menu", "nav_menu", "theme", "stylesheet", "template", "plugin", "plugins",
    "activate", "deactivate", "option", "option_value", "option_name", "user_login", "user_email", "user_pass", "display_name",
    "role", "capabilities", "all_roles", "taxonomy", "term", "term_id", "parent", "ping_status", "comment_status",
    "post_password", "post_name", "post_parent", "menu_order", "page_template", "page_options",
]


def trusted_share(names: Column, trusted=TRUSTED_NAMES) -> Column:
    """Share of the names that are trusted; 0 for none."""
    table = F.array(*[F.lit(t) for t in trusted])
    hits = F.size(F.filter(names, lambda n: F.array_contains(table, F.lower(n))))
    return F.when(F.size(names) > 0, hits / F.size(names)).otherwise(F.lit(0.0))


def long_or_special(params: DataFrame) -> DataFrame:
    """Rows with very long values or markup characters in cookies and headers."""
    score = points((F.octet_length("value") > 200, 15), (F.col("position").isin("cookie", "header") & F.col("value").rlike(r"[<>\"']"), 12))
    return params.withColumn("risk", score.cast("bigint")).filter(F.col("risk") > 0)
