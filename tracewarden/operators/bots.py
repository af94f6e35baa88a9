"""Bot columns: agent class, header signals, category vote, total and action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.audit import header
from tracewarden.functions.scores import first_of, labels, points, whole
from tracewarden.functions.text import matches

# Crawlers of search engines, SEO tools and social networks, (pattern, name, tier).
ENGINES = [
    ("Googlebot", "Google", "tier1"), ("Bingbot|msnbot", "Bing", "tier1"), ("DuckDuckBot", "DuckDuckGo", "tier2"), ("YandexBot", "Yandex", "tier1"),
    ("Exabot", "Exalead", "tier3"), ("Baiduspider", "Baidu", "tier1"), (r"Sogou\s+web\s+spider|Sogou\s+spider", "Sogou", "tier2"),
    ("360Spider|HaoSouSpider", "360", "tier2"), ("Sosospider", "Tencent_Soso", "tier3"), ("Bytespider", "ByteDance_Toutiao", "tier2"),
    ("ShenmaBot", "Shenma_UC", "tier2"), ("YisouSpider", "Yisou", "tier3"), ("YoudaoBot", "Youdao", "tier3"), ("JikeSpider", "Jike", "tier3"),
    ("Applebot", "Apple_Siri", "tier2"), ("facebookexternalhit|Facebot", "Facebook", "tier2"), ("Twitterbot", "Twitter_X", "tier2"),
    ("AhrefsBot", "Ahrefs", "seo"), ("SemrushBot", "Semrush", "seo"), ("MJ12bot", "Majestic", "seo"), ("DotBot", "Moz", "seo"), ("rogerbot", "Moz_Roger", "seo"),
    ("SearchmetricsBot", "Searchmetrics", "seo"), ("SEOkicks|Seobility", "SEO_Tools", "seo"), ("LinkedInBot", "LinkedIn", "social"), ("Pinterest", "Pinterest", "social"),
    ("Slackbot", "Slack", "social"), ("Discordbot", "Discord", "social"), ("TelegramBot", "Telegram", "social"), ("WhatsApp", "WhatsApp", "social"),
    ("SkypeUriPreview", "Skype", "social"), ("NaverBot|Yeti", "Naver", "tier2"), ("SeznamBot", "Seznam", "tier3"),
]
# Headless browsers, automation tools and AI crawlers.
HEADLESS = (r"HeadlessChrome|Puppeteer|Playwright|PhantomJS|Selenium|WebDriver|\bphantom\b|\bchromedriver\b|\bgeckodriver\b|\bsafaridriver\b|\bedgedriver\b|"
            r"\bwebdriver\b|Lighthouse|PageSpeed|Pingdom|GTmetrix|WebPageTest")
TOOLS = (r"\b(?:scrapy|curl|wget|python-requests|python-urllib|aiohttp|httpx|Go-http-client|okhttp|HttpClient|libwww-perl|Perl|Ruby|node-superagent|node-fetch|axios|"
         r"GuzzleHttp|Zend_Http_Client|Mechanize|Nmap|nikto|sqlmap|masscan|ZGrab|Hydra|Nessus|Acunetix|AppScan|Burp|WebInspect)\b|\bJava/|\bJakarta\s+Commons|\bPHP/")
AI = r"\b(?:GPTBot|ChatGPT-User|ClaudeBot|Claude-Web|CCBot|anthropic-ai|PerplexityBot|Diffbot|OAI-SearchBot|AI2Bot|cohere-ai)\b"
SOCIAL = "facebookexternalhit|Facebot|Twitterbot|LinkedInBot|WhatsApp|TelegramBot|Slackbot|Discordbot|Pinterest|SkypeUriPreview"
BROWSER_HEADERS = ["accept", "accept-language", "accept-encoding"]


def agent_class(df: DataFrame, agent: str) -> DataFrame:
    """Adds engine, tier and flags for the agent text, and ``agent_kind`` by danger.

    An agent that claims a search engine and also a tool or headless browser is forged.
    """
    a = F.coalesce(F.col(agent), F.lit(""))

    def has(p: str) -> Column:
        return matches(a, "(?i)" + p)

    d = df.withColumn("engine", first_of([(has(p), n) for p, n, _ in ENGINES], None)).withColumn(
        "tier", first_of([(F.col("engine") == n, t) for _, n, t in ENGINES], None))
    d = d.withColumn("is_tool", has(TOOLS)).withColumn("is_headless", has(HEADLESS)).withColumn("is_ai", has(AI)).withColumn("is_social", has(SOCIAL))
    c = F.col
    d = d.withColumn("forged", c("engine").isNotNull() & (c("is_tool") | c("is_headless")))
    return d.withColumn("agent_kind", first_of([
        (c("forged"), "forged"), (c("is_tool"), "tool"), (c("is_headless"), "headless"), (c("is_ai"), "ai"), (c("is_social"), "social"),
        (c("engine").isNotNull(), "search_engine"), (a == "", "empty")], "browser"))


def header_signals(df: DataFrame, headers: str, engine: Column, spider: float = 0.3) -> DataFrame:
    """Adds ``signals`` (names) and ``header_score`` for missing and odd headers.

    Crawlers of search engines lack some browser headers by nature, so these weigh less.
    """
    h = F.col(headers)
    get = {n: header(h, n) for n in ("accept", "accept-language", "user-agent", "host", "referer", "x-forwarded-for", "connection")}
    agent, se = get["user-agent"] != "", F.coalesce(engine, F.lit(False))
    moz = F.contains(F.lower(get["user-agent"]), F.lit("mozilla"))
    cut = F.when(se, spider).otherwise(1.0)
    missing = sum((F.when(F.trim(header(h, n)) == "", 1).otherwise(0) for n in BROWSER_HEADERS), F.lit(0))
    names = F.map_keys(h)
    pos_a, pos_h = F.array_position(names, "user-agent"), F.array_position(names, "host")

    def scaled(n) -> Column:
        return F.round((n if isinstance(n, Column) else F.lit(n)) * cut).cast("int")

    acc, lang = get["accept"], get["accept-language"]
    rules = [
        ("missing_browser_headers", missing >= 2, scaled(missing * 10)), ("missing_accept", (acc == "") & agent & ~se, F.lit(12)),
        ("wildcard_accept", acc == "*/*", scaled(18)),
        ("no_html_accept", (acc != "") & (acc != "*/*") & ~acc.rlike("(?i)text/html|application/xhtml") & moz & ~se, F.lit(15)),
        ("missing_accept_language", (lang == "") & agent & ~se, F.lit(15)), ("wildcard_accept_language", lang == "*", scaled(20)),
        ("plain_accept_language", lang.rlike(r"(?i)^[a-z]{2}(?:,[a-z]{2})*$"), scaled(8)),
        ("connection_close", (F.lower(get["connection"]) == "close") & moz & ~se, F.lit(10)), ("missing_host", (get["host"] == "") & agent & (F.size(names) > 0), F.lit(25)),
        ("abnormal_header_order", (pos_a > 0) & (pos_h > 0) & (pos_a < pos_h), scaled(12)), ("missing_referer", (get["referer"] == "") & moz & ~se, F.lit(6)),
        ("long_forwarded_chain", F.size(F.split(get["x-forwarded-for"], ",")) > 4, F.lit(15)),
    ]
    total = F.lit(0)
    for _, cond, w in rules:
        total = total + F.when(cond, w).otherwise(0)
    return df.withColumn("signals", labels(*[(c & (w > 0), n) for n, c, w in rules])).withColumn("header_score", total)


def behaviour_score(variety: Column, uniformity: Column, bias: Column, rate: Column) -> Column:
    """0..100 from path variety, even gaps, API-only access and requests per minute."""
    return F.least(F.lit(100), whole(F.least(F.lit(30.0), variety * 0.30)) + whole(F.least(F.lit(25.0), uniformity * 0.25))
                   + whole(F.least(F.lit(25.0), bias * 0.25)) + first_of([(rate > 120, 20), (rate > 60, 12), (rate > 30, 6)], 0))


def probing_score(chain: Column, probes: Column, errors: Column, malicious: Column) -> Column:
    """0..100 from attack-chain score, probes of sensitive paths and the error rate in percent."""
    return F.least(F.lit(100), whole(F.least(F.lit(60.0), chain * 0.6)) + F.least(F.lit(25), probes * 5)
                   + first_of([(errors > 50, 15), (errors > 20, 8)], 0) + F.when(malicious, 10).otherwise(0))


def bot_total(fingerprint: Column, semantic: Column, behaviour: Column, chain: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(fingerprint * 0.30 + semantic * 0.30 + behaviour * 0.25 + chain * 0.15))).cast("bigint")


def bot_action(category: Column, score: Column) -> Column:
    """What to do with a client of the category at the score."""
    def stepped(high: str, mid: str, low: str) -> Column:
        return first_of([(score >= 75, high), (score >= 50, mid)], low)

    return first_of([
        (category.isin("search_engine", "social_media", "ai"), F.when(score >= 85, "challenge").otherwise("allow")),
        (category == "malicious_bot", stepped("block", "limit", "challenge")), (category == "crawler", stepped("limit", "challenge", "allow")),
        (category == "human", stepped("limit", "challenge", "allow"))], stepped("block", "challenge", "allow"))


CATEGORIES = ["human", "search_engine", "social_media", "ai", "crawler", "malicious_bot"]


def category_vote(df: DataFrame, *, verified: Column, fingerprint: Column, semantic: Column, chain: Column, variety: Column, uniformity: Column, bias: Column) -> DataFrame:
    """Adds ``category`` and ``category_confidence`` from votes of agent, headers and behaviour.

    Needs the columns of ``agent_class`` and ``signals``. The first category wins a tie.
    """
    c = F.col
    se = c("engine").isNotNull()

    def signal(n: str) -> Column:
        return F.array_contains("signals", n)

    votes = {
        "human": points(((fingerprint < 25) & (semantic < 30) & (chain < 20), 40)),
        "search_engine": points((se & verified & ~c("forged"), 50)),
        "social_media": points((c("is_social"), 45)),
        "ai": points((c("is_ai"), 70)),
        "crawler": points((se & ~(verified & ~c("forged")), 20), (c("agent_kind") == "empty", 25), (signal("missing_browser_headers"), 15), (signal("wildcard_accept"), 15),
                          (signal("missing_accept_language"), 15), (signal("missing_host"), 15), (signal("long_forwarded_chain"), 15), (variety >= 60, 20), (uniformity >= 70, 20),
                          ((semantic >= 60) & ~c("is_tool") & ~c("is_headless"), 15)),
        "malicious_bot": points((c("is_tool"), 40), (c("is_tool") & se, 35), (c("is_headless") & se, 45), (bias >= 70, 20), (chain >= 50, 30),
                                ((semantic >= 60) & (c("is_tool") | c("is_headless")), 15)),
    }
    ranked = F.sort_array(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("r"), F.lit(n).alias("n")) for i, (n, v) in enumerate(votes.items())]), asc=False)
    d = df.withColumn("_v", ranked)
    top, second = F.get("_v", F.lit(0)), F.get("_v", F.lit(1))
    conf = F.least(F.lit(100.0), F.greatest(F.lit(30.0), F.round(40 + top["v"] * 0.5 + (top["v"] - second["v"]) * 1.5)))
    return d.withColumn("category", F.when(top["v"] < 15, "human").otherwise(top["n"])).withColumn(
        "category_confidence", F.when(top["v"] < 15, 50).otherwise(conf).cast("bigint")).drop("_v")
