"""URI columns: parts, templates, signatures, scene and endpoint classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of

# File extensions served as static assets.
STATIC_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "ico", "avif", "apng", "css", "js", "woff", "woff2", "ttf", "eot",
    "otf", "pdf", "zip", "rar", "gz", "tar", "mp3", "mp4", "avi", "mov", "wav", "flv", "webm", "map", "txt", "webmanifest",
    "xml", "json",
]

# Path words of trusted scenes. Paths below a listed word match too.
HARD_SCENES = [
    "login", "signin", "sign-in", "sign_up", "signup", "sign-up", "register", "registration", "auth", "my-account", "account",
    "lostpassword", "lost-password", "resetpassword", "reset-password", "wp-login.php", "user-login", "member-login",
    "customer-login", "payment", "pay", "checkout", "callback", "notify", "return_url", "alipay", "wechat", "wechatpay",
    "wxpay", "paypal", "stripe", "notify_url", "callback_url", "ipn", "webhook", "wc-api", "wc-ajax", "wc_order", "order-pay",
    "order-received", "add_payment_method", "add-payment-method", "payment-method", "cart", "epay", "payjs", "payapi",
    "payepay", "hupijiao", "oauth", "oauth2", "oauth2callback", "sso", "saml", "contact", "feedback", "subscribe",
    "newsletter", "api/pay", "api/order", "api/callback", "api/notify", "api/login", "api/auth", "wp-comments-post.php",
    "wp-links-opml.php", "wp-trackback.php", "wp-activate.php", "wp-signup.php", "wp-mail.php", "wp-feed.php",
    "wp-robots.php", "wp-app.php", "wp-load.php", "wp-blog-header.php", "wp-settings.php", "wp-cron.php", "xmlrpc.php",
    "wp-json", "wp-admin", "wp/v2", "wp/v3", "wp/v4", "wp-rest", "wp-includes/rest-api", "wp-includes/feed.php",
    "wp-includes/rss-functions.php", "wp-includes/http.php", "wp-includes/requests", "wp-includes/canonical.php",
    "wp-includes/class-wp.php", "wp-includes/rewrite.php", "admin-ajax", "ajax", "async-upload", "asyncupload",
    "upload-attachment", "elementor", "elementor_ajax", "et_pb_contact_form_submit", "divi", "avada", "visual_composer",
    "beaver_builder", "fl-builder", "oxygen", "wpbakery", "facebook", "google", "twitter", "github", "qq", "weibo",
    "social-login", "social_login",
]
SOFT_SCENES = [
    "comment", "comments", "review", "reviews", "search", "s", "q", "keyword", "forum", "post", "thread", "reply", "topic",
    "board", "edit", "draft", "publish", "compose", "message", "chat", "mail", "inbox", "conversation", "profile",
    "user-profile", "member", "members", "download", "attachment", "file", "avada", "visual_composer", "beaver_builder",
    "fl-builder", "oxygen", "wpbakery",
]
SEARCH_NAMES = ["s", "q", "search", "keyword", "kw", "query"]

# Endpoint kinds by path segment, first kind wins.
ENDPOINT_KINDS = [
    ("login", ["login", "signin", "wp-login"]),
    ("register", ["register", "signup", "sign-up", "create-account"]),
    ("password_reset", ["reset", "forgot", "recover"]),
    ("logout", ["logout", "signout"]),
    ("search", ["search", "query", "find"]),
    ("upload", ["upload", "uploads", "import"]),
    ("admin", ["admin", "manage", "management", "dashboard", "wp-admin", "administrator"]),
    ("payment", ["pay", "payment", "checkout", "cart"]),
]
# Resource types by path segment.
RESOURCE_TYPES = {
    "user": ["users", "user", "profile", "account", "accounts", "member", "members", "u"],
    "order": ["orders", "order", "invoice", "invoices"],
    "product": ["products", "product", "goods", "items"],
    "file": ["files", "file", "upload", "uploads", "attachments", "attachment", "documents", "docs"],
    "article": ["articles", "article", "posts", "post", "comments", "comment"],
    "auth": ["auth", "login", "signin", "logout", "register", "signup", "token", "session", "reset", "forgot", "recover"],
    "admin": ["admin", "manage", "management", "dashboard", "settings", "config", "system"],
    "search": ["search", "query", "find"],
    "payment": ["cart", "checkout", "pay", "payment"],
}


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def path_and_query(uri: Column) -> Column:
    """URI without scheme, authority and fragment."""
    rest = F.regexp_replace(uri, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*", "")
    return F.regexp_replace(rest, r"#.*$", "")


def path_of(uri: Column) -> Column:
    return F.regexp_extract(path_and_query(uri), r"^([^?]*)", 1)


def query_of(uri: Column) -> Column:
    return F.regexp_extract(path_and_query(uri), r"\?(.*)$", 1)


def host_of(uri: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(uri, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def query_pairs(uri: Column) -> Column:
    """Array of (name, value) of the query string, undecoded, pairs without ``=`` left out."""
    pairs = F.filter(F.split(query_of(uri), "&"), lambda p: F.contains(p, F.lit("=")))
    return F.transform(pairs, lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("name"), F.regexp_replace(p, r"^[^=]*=", "").alias("value")))


def template_prefix_ids(uri: Column) -> Column:
    """Digits or 16 and more hex digits after a slash become placeholders, also as a prefix."""
    return F.regexp_replace(F.regexp_replace(path_of(uri), r"/\d+", "/{id}"), r"(?i)/[0-9a-f]{16,}", "/{hash}")


def template_segments(uri: Column) -> Column:
    """Whole segments of digits or of 8 and more hex digits become placeholders."""
    shaped = F.transform(segments(path_of(uri)), lambda s: F.when(s.rlike(r"^\d+$"), "{id}").when(
        s.rlike(r"(?i)^[0-9a-f]{8,}$"), "{hash}").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(shaped, "/"))


def template_ids(uri: Column) -> Column:
    """Whole numeric segments become ``{id}``; everything from ``?`` on is cut."""
    return F.regexp_replace(F.regexp_replace(uri, r"\?.*$", ""), r"/\d+(?=/|$)", "/{id}")


def pattern_id(method: Column, template: Column, names: Column) -> Column:
    """Id of method, template and sorted parameter names."""
    return F.md5(F.concat_ws("|", F.upper(method), template, F.array_join(F.array_sort(names), ",")))


def request_signature(method: Column, uri: Column, params: Column) -> Column:
    """Id of method, URI and the parameters sorted by name; ``params`` is (name, value) structs."""
    ordered = F.transform(F.array_sort(params), lambda p: F.concat_ws("=", p["name"], p["value"]))
    return F.md5(F.concat_ws("|", F.upper(method), uri, F.array_join(ordered, "&")))


def is_static(path: Column, extensions=STATIC_EXTENSIONS) -> Column:
    """Ends in a static extension and holds no script file on the way."""
    return path.rlike(r"(?i)\.(?:" + "|".join(extensions) + r")$") & ~path.rlike(r"(?i)/[^/]*\.php(?:/|$)")


def settle_path(path: Column) -> Column:
    """Lower-case path with ``.``, ``..`` and doubled slashes resolved, however deep; a last slash stays."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: ~x.isin("", "."))
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    end = F.when((F.size(kept) > 0) & path.rlike(r"/(?:\.{1,2})?$"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def holds_word(path: Column, keywords) -> Column:
    """A segment equals a keyword, the path starts with a longer one, or a script name holds one."""
    simple = [k for k in keywords if "/" not in k]
    nested = [k for k in keywords if "/" in k]
    stem = F.regexp_extract(path, r"([^/]*)\.php$", 1)
    parts = F.split(stem, "[-_.]")
    hit = F.arrays_overlap(segments(path), words(simple)) | F.arrays_overlap(F.array_append(parts, stem), words(simple))
    for k in nested:
        hit = hit | (path == f"/{k}") | path.startswith(f"/{k}/")
    return hit


def scene(uri: Column, method: Column, hard=HARD_SCENES, soft=SOFT_SCENES) -> Column:
    """hard_skip, soft_skip or full_check by path word, then by query names and words."""
    path, query = settle_path(path_of(uri)), F.lower(query_of(uri))
    is_hard, is_soft = holds_word(path, hard), holds_word(path, soft)
    plain = ~is_hard & ~is_soft
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    soft_query = plain & F.arrays_overlap(names, words(SEARCH_NAMES))
    hard_query = plain & ~soft_query & F.exists(words(hard), lambda k: F.contains(query, k))
    hard_any = is_hard | hard_query
    return first_of([(hard_any & F.upper(method).isin("POST", "PUT", "PATCH"), "hard_skip"), (hard_any, "soft_skip"),
                     (is_soft | soft_query, "soft_skip")], "full_check")


def resource_type(uri: Column) -> Column:
    """Type of the first path segment that names one."""
    flat = F.create_map(*[x for t, ws in RESOURCE_TYPES.items() for w in ws for x in (F.lit(w), F.lit(t))])
    types = F.transform(segments(F.lower(path_of(uri))), lambda s: F.try_element_at(flat, s))
    return F.coalesce(F.get(F.filter(types, lambda t: t.isNotNull()), F.lit(0)), F.lit("unknown"))


def endpoint_kind(uri: Column) -> Column:
    segs = segments(F.lower(path_of(uri)))
    rules = [(F.arrays_overlap(segs, words(ws)), k) for k, ws in ENDPOINT_KINDS]
    known = resource_type(uri) != "unknown"
    return first_of([*rules, (known & F.array_contains(segs, "api"), "api_resource"), (known, "resource")], "unknown")


def flow_state(uri: Column, kind: Column) -> Column:
    """Step of the business flow the endpoint belongs to."""
    rt = resource_type(uri)
    has_id = F.exists(segments(path_of(uri)), lambda s: s.rlike(r"^\d+$"))
    static = path_of(uri).rlike(r"(?i)\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|eot|map|html?|xml|txt)$")
    return first_of([
        (kind.isin("login", "register", "password_reset", "logout"), "pre_auth"),
        ((kind == "admin") | (rt == "admin"), "high_privilege"), ((rt != "unknown") & has_id, "resource_access"),
        (rt != "unknown", "post_auth"), (static, "static")], "unknown")


# Names that make a parameter suspicious.
SUSPICIOUS_NAMES = ["cmd", "exec", "command", "shell", "eval", "code", "file", "path", "url", "redirect", "return", "jump",
                    "include", "require"]


def structure_score(uri: Column, params: Column) -> Column:
    """Points for URI length, depth, suspicious names and odd character shares of the values."""
    vals = F.array_join(F.transform(params, lambda p: p["value"]), " ")
    n = F.octet_length(vals)

    def share(keep: str) -> Column:
        return F.octet_length(F.regexp_replace(vals, keep, "")) / F.greatest(n, F.lit(1))

    odd = F.size(F.filter(params, lambda p: F.exists(words(SUSPICIOUS_NAMES), lambda w: F.contains(F.lower(p["name"]), w))))
    total = F.lit(0)
    for cond, pts in [
        (F.octet_length(uri) > 200, 15), (F.length(uri) - F.length(F.replace(uri, F.lit("/"), F.lit(""))) > 8, 10),
        (uri.rlike(r"\.\./"), 20), (uri.rlike(r"(?i)\.(?:php|asp|jsp|cgi|env|sql)$"), 10),
        (uri.rlike(r"(?i)(?:union|select|concat|script|onerror|javascript:)"), 25),
        ((share("[^A-Z]") > 0.5) & (share("[^0-9]") > 0.3), 15), ((n > 0) & (share(r"[a-zA-Z0-9\s]") > 0.4), 15),
    ]:
        total = total + F.when(cond, pts).otherwise(0)
    return F.least(F.lit(100), total + odd * 8)
