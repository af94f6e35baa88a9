"""Checks of one request's headers, tokens, session ids and stored credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of, points
from tracewarden.functions.text import java_regex
from tracewarden.functions.uri import host_of

# Block-message classes, (class, substrings), first class wins.
MESSAGE_CLASSES = [
    ("sql_injection", ["sql", "union", "select"]),
    ("xss", ["xss", "script", "onerror"]),
    ("file_upload", ["文件包含", "upload", "上传"]),
    ("rate_abuse", ["cc", "频繁", "rate"]),
    ("parameter_pollution", ["参数污染"]),
    ("path_traversal", ["遍历", "../"]),
    ("command_injection", ["命令", "exec"]),
]


def message_class(msg: Column) -> Column:
    low = F.lower(msg)
    rules = []
    for name, subs in MESSAGE_CLASSES:
        cond = F.lit(False)
        for s in subs:
            cond = cond | F.contains(low, F.lit(s))
        rules.append((cond, name))
    return first_of(rules, "other")


# Stored-credential formats, (format, pattern), first wins.
CREDENTIAL_FORMATS = [
    ("bcrypt", r"^\$2[aby]\$\d{2}\$"), ("phpass", r"^\$[PH]\$"), ("argon2id", r"^\$argon2id\$"), ("argon2i", r"^\$argon2i\$"),
    ("md5", r"(?i)^[a-f0-9]{32}$"), ("sha1", r"(?i)^[a-f0-9]{40}$"), ("sha256", r"(?i)^[a-f0-9]{64}$"),
    ("sha512", r"(?i)^[a-f0-9]{128}$"),
]


def credential_format(stored: Column, dual_prefix: str = "$dual$") -> Column:
    """Format of a stored hash; ``dual_prefix`` marks two hashes kept side by side."""
    return first_of([(stored.isNull() | (stored == ""), "empty"), (stored.startswith(dual_prefix), "dual"),
                     *[(stored.rlike(p), n) for n, p in CREDENTIAL_FORMATS]], "unknown")


# Weak session ids, (pattern, severity).
WEAK_SESSION_IDS = [
    (r"(?i)^(?:admin|root|test|user|guest|demo|12345|abcdef)\b", 80), (r"^[0-9]{1,6}$", 75), (r"(?i)^[a-z]{1,10}$", 70),
    (r"\.\.", 65), (r"[<>\"']", 60), (r"(?i)^(?:http|ftp|file|php):", 70),
]


def session_id_weakness(sid: Column) -> Column:
    """Worst severity of the pattern table and the length bands; 0 for none or no id."""
    n = F.octet_length(sid)
    band = first_of([(n < 10, 65), (n < 16, 40)], 0)
    worst = F.greatest(band, *[F.when(sid.rlike(java_regex(p)), s).otherwise(0) for p, s in WEAK_SESSION_IDS])
    return F.when(sid.isNull() | (sid == ""), 0).otherwise(worst)


TOKEN_HEADERS = ["x-csrf-token", "x-xsrf-token", "x-csrftoken", "x-xsrftoken"]


def header(headers: Column, name: str) -> Column:
    """Header value, empty if missing. Keys are lower case."""
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))


def cross_site_risk(method: Column, headers: Column) -> Column:
    """Points for referer, origin and host that do not fit together and missing tokens."""
    m = F.upper(method)
    referer, origin, host = (header(headers, n) for n in ("referer", "origin", "host"))
    rh, oh = host_of(referer), host_of(origin)
    token = F.lit(False)
    for n in TOKEN_HEADERS:
        token = token | (header(headers, n) != "")
    return F.least(F.lit(100), points(
        ((rh != "") & (oh != "") & (rh != oh), 30), ((oh != "") & (host != "") & (oh != F.lower(host)), 25),
        (m.isin("POST", "PUT", "DELETE", "PATCH") & ~token, 15), ((m == "POST") & (referer == ""), 20)))


# Shortest signature per algorithm, in characters.
SIGNATURE_LENGTHS = {"hs256": 43, "hs384": 64, "hs512": 86, "rs256": 342, "ps256": 342, "rs384": 512, "ps384": 512,
                     "rs512": 683, "ps512": 683, "es256": 86}


def token_audit(df: DataFrame, token: str, as_of: Column, leeway: int = 60, longest: int = 8192, claim_items: int = 100) -> DataFrame:
    """Adds ``token_issue``: the first thing wrong with a signed token, null if nothing is.

    ``as_of`` is the time in epoch seconds. Texts without three parts are no tokens, but two
    parts are an unsigned one.
    """
    raw = F.regexp_replace(F.trim(F.col(token)), r"(?i)^bearer ", "")

    def decoded(part: Column) -> Column:
        std = F.translate(part, "-_", "+/")
        padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), F.lit("="))
        return F.try_to_binary(padded, F.lit("base64")).cast("string")

    d = df.withColumn("_raw", raw).withColumn("_p", F.split("_raw", r"\."))
    d = d.withColumn("_h", decoded(F.get("_p", F.lit(0)))).withColumn("_b", decoded(F.get("_p", F.lit(1))))
    d = d.withColumn("_hj", F.from_json("_h", "alg string, typ string, kid string"))
    d = d.withColumn("_bj", F.from_json("_b", "map<string,string>"))
    c = F.col
    n = F.size("_p")
    sig = F.get("_p", F.lit(2))
    alg = F.lower(c("_hj.alg"))
    least = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in SIGNATURE_LENGTHS.items() for x in (F.lit(k), F.lit(v))]), alg), F.lit(0))

    def claim(name: str) -> Column:
        return F.try_element_at(c("_bj"), F.lit(name))

    def not_number(name: str) -> Column:
        return claim(name).isNotNull() & ~claim(name).rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")

    def number(name: str) -> Column:
        return claim(name).try_cast("double")

    standard = F.array(*[F.lit(k) for k in ("iss", "sub", "aud", "exp", "nbf", "iat", "jti", "alg", "typ", "cty", "kid", "x5u", "x5c", "x5t", "x5t#S256")])
    bulky = F.exists(F.map_entries("_bj"), lambda e: ~F.array_contains(standard, e["key"]) & ~e["key"].startswith("_")
                     & (F.coalesce(F.json_array_length(e["value"]), F.lit(0)) > claim_items))
    body = c("_bj").isNotNull()
    base64url = r"^[A-Za-z0-9_\-]*=*$"
    issue = first_of([
        (F.coalesce(c("_raw"), F.lit("")) == "", None), (n == 2, "unsigned"), (n != 3, None), (sig == "", "empty_signature"), (alg == "none", "alg_none"),
        (~F.contains(F.lower(c("_hj.typ")), F.lit("jwt")), "odd_type"), (F.octet_length(c("_hj.kid")) > 255, "long_key_id"),
        (F.octet_length(sig) < least, "short_signature"), (body & claim("exp").isNull(), "no_expiry"),
        (body & not_number("exp"), "bad_expiry"), (body & (number("exp") < as_of - leeway), "expired"),
        (body & not_number("nbf"), "bad_not_before"), (body & (number("nbf") > as_of), "not_yet_valid"),
        (body & not_number("iat"), "bad_issue_time"), (body & claim("sub").rlike(r"^[\[{]"), "subject_is_list"),
        (body & bulky, "bulky_claim"), (~F.get("_p", F.lit(0)).rlike(base64url), "bad_header_encoding"),
        (~F.get("_p", F.lit(1)).rlike(base64url), "bad_body_encoding"), (F.octet_length("_raw") > longest, "oversize")], None)
    return d.withColumn("token_issue", issue).drop("_raw", "_p", "_h", "_b", "_hj", "_bj")


def smuggling_issue(headers: Column) -> Column:
    """Length and transfer headers that two servers may read differently; null if fine."""
    cl, te = F.try_element_at(headers, F.lit("content-length")), F.try_element_at(headers, F.lit("transfer-encoding"))
    return first_of([
        (cl.isNotNull() & te.rlike("(?i)chunked"), "length_and_chunked"), (te.rlike(r"(?i)chunked[\s,]+[^,]*chunked"), "repeated_chunked"),
        (cl.rlike(r"^\s*\d+\s*(?:,\s*\d+\s*)+$"), "several_lengths"), (~cl.rlike(r"^\s*\+?\d+\s*$"), "bad_length")], None)


def admissible(method: Column, content_type: Column, methods=("GET", "POST", "HEAD", "OPTIONS"),
               types=("application/x-www-form-urlencoded", "multipart/form-data", "application/json", "application/xml", "text/xml", "")) -> Column:
    """Allowed method, and an allowed content type if one is given."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return method.isin(*methods) & kind.isin(*types)
