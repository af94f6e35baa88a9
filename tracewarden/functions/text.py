"""Text columns: decoding layers, script mixture, feature rows, entropy, obfuscation."""

from __future__ import annotations

import re
import re._constants as _re
import re._parser as _re_parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracewarden.functions.scores import first_of, labels, points

# Full-width forms lie at a fixed distance from the ASCII characters.
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
_FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))

# Letters that look like Latin ones, per script as (letters, replacements).
LOOK_ALIKES = [
    ("аеосрухіјѕԛԝҽҿӷӏһ", "aeocpyxijsqwecgih"),
    ("αβγδεζηικλμνξπρστυφχψωο", "abgdezhiklmvxprstufxywo"),
    ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ", "wbqdeqeetzilxckhjqcmynsocpjrsvtrcpqof"),
    ("äöüñéèêëíìîïóòôõúùûýÿçşğ", "aouneeeeiiiioooouuuyycsg"),
    ("ىهالكمنع", "yoalkmne"),
    ("אויכמסעצ", "xiikmsec"),
    ("าหมอยรลวคตนบปสง", "anmoyrlwctnbpsg"),
    ("ລສអកតនបម", "nsaktnbm"),
    ("ဝမတနပကသ", "omtnpks"),
    ("रनलतकमस", "dnltkms"),
    ("₿€₹₽₩₪ℕℤℚℝℂ", "BERPWSNZQRC"),
]
LOOK_FROM = "".join(a for a, _ in LOOK_ALIKES)
LOOK_TO = "".join(b for _, b in LOOK_ALIKES)
LOOK_PAIRS = [("ß", "ss"), ("æ", "ae"), ("œ", "oe")]

ZERO_WIDTH = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{2060}-\x{2064}]"
COMMENTS = r"(?is)/\*.*?\*/|--[^\n]*|#.*"

# Ranges of the eight scripts that are told apart.
SCRIPT_RANGES = [r"[a-zA-Z]", r"[\x{0400}-\x{04FF}]", r"[\x{0370}-\x{03FF}]", r"[\x{0530}-\x{058F}]",
                 r"[\x{0600}-\x{06FF}]", r"[\x{0E00}-\x{0E7F}]", r"[\x{0E80}-\x{0EFF}]", r"[\x{1000}-\x{109F}]"]
SPECIALS = "<>\"';%|&`$(){}\\/*#=?![]"

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


#: A word edge before one of several words, and one after a character that is surely of a word.
_EDGE_GROUP = re.compile(r"\\b(?=\(\?:((?:[A-Za-z0-9_]+\|)*[A-Za-z0-9_]+)\)\\b)")
_EDGE_BEHIND = re.compile(r"(?<=(?<!\\)[A-Za-z0-9_])\\b")


def _first_chars(items) -> set[str] | None:
    """The ASCII word characters with one of which every match of a parsed pattern begins, or None."""
    for op, arg in items:
        if op is _re.LITERAL:
            return {chr(arg)} if re.fullmatch("[A-Za-z0-9_]", chr(arg)) else None
        if op is _re.SUBPATTERN:
            return None if arg[1] or arg[2] else _first_chars(arg[3])
        if op in (_re.MAX_REPEAT, _re.MIN_REPEAT):
            return _first_chars(arg[2]) if arg[0] >= 1 else None
        if op in (_re.BRANCH, _re.IN):
            each = [_first_chars(b) for b in (arg[1] if op is _re.BRANCH else [[x] for x in arg])]
            return None if None in each else set().union(*each)
        return None
    return None


def _edges_ahead(pattern: str) -> str:
    """Word edges before what surely begins with a word character, as a look at that one and one behind."""
    parts = re.split(r"(?<!\\)\\b", pattern)
    out = parts[0]
    for k, part in enumerate(parts[1:], 1):
        # what follows this edge, up to the end of its group; a branch of that group may not begin here
        rest, depth, at = r"\b".join(parts[k:]), 0, 0
        for at, x in enumerate(re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", rest, re.S)):
            depth += (x[0] == "(") - (x[0] == ")")
            if depth < 0 or depth == 0 and x[0] == "|":
                rest = rest[: x.start()]
                break
        try:
            first = _first_chars(_re_parser.parse(rest))
        except re.error:  # of the other dialect
            first = None
        out += (rf"(?=[{''.join(sorted(first))}])(?<![A-Za-z0-9_])" if first else r"\b") + part
    return out


def java_regex(pattern: str) -> str:
    """Word edges between ASCII word characters only, whatever letters stand around.

    Beside a character that is surely of a word one look aside tells the edge; before a word or one of several
    their first letters are looked at first, so that most places of a text cost one test.
    """
    group = _EDGE_GROUP.search(pattern)
    if group:
        first = "".join(sorted({w[0] for w in group[1].split("|")}))
        pattern = pattern[: group.start()] + f"(?=[{first}])(?<![A-Za-z0-9_]){group[0][2:]}" + pattern[group.end() :]
        words = f"(?:{group[1]})"
        pattern = pattern.replace(words + r"\b", words + "(?![A-Za-z0-9_])", 1)
    pattern = _edges_ahead(pattern)
    if "\\x" not in pattern and "\\u" not in pattern:  # the last digit of an escaped character is none of the text
        pattern = _EDGE_BEHIND.sub("(?![A-Za-z0-9_])", pattern)
    return pattern.replace(r"\b", _EDGE)


def required_pieces(pattern: str) -> list[str] | None:
    """Lower-case substrings of which every match holds one, or None if there is no such list.

    Read from the pattern itself: the longest literal run that cannot be left out, one per
    branch where the pattern branches.
    """
    def of(items) -> list[str] | None:
        best: list[str] | None = None
        run = ""
        options = []
        for op, arg in items:
            if op is _re.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if run:
                options.append([run])
            run = ""
            if op is _re.SUBPATTERN:
                options.append(of(arg[3]))
            elif op in (_re.MAX_REPEAT, _re.MIN_REPEAT) and arg[0] >= 1:
                options.append(of(arg[2]))
            elif op is _re.BRANCH:
                each = [of(b) for b in arg[1]]
                options.append(None if None in each else [x for e in each for x in e])
        if run:
            options.append([run])
        for o in options:
            if o and (best is None or min(map(len, o)) > min(map(len, best))):
                best = o
        return best

    return of(_re_parser.parse(pattern))


def matches(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether the text holds a match of the pattern.

    With ``low``, the lower-case text, the pattern runs only where a substring that every
    match needs is found: a byte scan instead of a regex walk for most rules and texts.
    """
    hit = text.rlike(java_regex(pattern))
    pieces = required_pieces(pattern) if low is not None else None
    if not pieces:
        return hit
    gate = F.contains(low, F.lit(pieces[0]))
    for p in pieces[1:]:
        gate = gate | F.contains(low, F.lit(p))
    return gate & hit


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java_regex(pattern)))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are in ``chars``.

    Up to three characters are taken out by byte searches, which need no object per character.
    """
    if 0 < len(chars) <= 3:
        left = text
        for c in dict.fromkeys(chars):
            left = F.replace(left, F.lit(c), F.lit(""))
        return F.length(text) - F.length(left)
    return F.length(text) - F.length(F.translate(text, chars, ""))


def count_runs(text: Column, one: str) -> Column:
    """How many characters of the text the class ``one`` matches: what is left without their runs, one match a run."""
    return F.length(text) - F.length(F.regexp_replace(text, one + "+", ""))


def char_grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters in order, with repeats.

    One pass of an empty match that looks ahead; ``substr`` by position would walk the text
    from its start every time.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def url_decoded(text: Column) -> Column:
    """Percent-decoded text; malformed escapes leave the text as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def fold_fullwidth(text: Column) -> Column:
    return F.translate(text, _FULL, _ASCII)


def fold_look_alikes(text: Column) -> Column:
    out = F.translate(text, LOOK_FROM, LOOK_TO)
    for a, b in LOOK_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def strip_comments(text: Column) -> Column:
    kept = F.regexp_replace(text, r"(?i)/\*!\d+\s*([^*]*)\*/", " $1 ")
    return F.regexp_replace(kept, COMMENTS, " ")


def fold_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def base64_decoded(text: Column) -> Column:
    """A whole text of base64 that decodes to printable UTF-8 is decoded."""
    shaped = text.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(text) > 8) & (F.length(text) % 4 == 0) & ~text.rlike("^0x[0-9a-fA-F]+$")
    plain = F.try_to_binary(F.when(shaped, text), F.lit("base64"))
    decoded = F.when(F.is_valid_utf8(plain.cast("string")), plain.cast("string"))
    return F.when(decoded.rlike(r"^[\x20-\x7E\s]+$"), decoded).otherwise(text)


def unwrapped(text: Column, passes: int) -> Column:
    """Struct (x, depth, transforms, url, base64, done): percent and base64 layers taken off until nothing changes."""

    def step(s: Column, _: Column) -> Column:
        def after(u: Column, b: Column) -> Column:
            cu, cb = u != s["x"], b != u
            return F.struct(
                b.alias("x"), (s["depth"] + (cu | cb).cast("int")).alias("depth"), (s["transforms"] + cu.cast("int") + cb.cast("int")).alias("transforms"),
                (s["url"] | cu).alias("url"), (s["base64"] | cb).alias("base64"), (~cu & ~cb).alias("done"))

        # nested so that each layer is decoded once
        one = F.transform(F.array(url_decoded(s["x"])), lambda u: F.transform(F.array(base64_decoded(u)), lambda b: after(u, b))[0])[0]
        return F.when(s["done"] | s["x"].isNull(), s).otherwise(one)

    no = F.lit(False)
    start = F.struct(text.alias("x"), F.lit(0).alias("depth"), F.lit(0).alias("transforms"), no.alias("url"), no.alias("base64"), no.alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, step) if passes else start


def decode_layers(df: DataFrame, text: str, passes: int = 12) -> DataFrame:
    """Adds ``decoded`` and a profile of the layers that changed the text.

    ``depth`` counts the decoding passes with a change. They end when a pass changes nothing;
    ``passes`` is the limit for texts that never settle. Later layers run once. ``complexity`` is 8 per depth, 2 per change, 5 per kind, 10 more for base64, at
    most 100.
    """
    d = df.withColumn("_w", unwrapped(F.col(text), passes))
    d = d.select(*df.columns, F.col("_w.x").alias("_x"), "_w.depth", "_w.transforms", F.col("_w.url").alias("_url"), F.col("_w.base64").alias("_base64"))
    flags = ["url", "base64"]
    for name, fn in (("fullwidth", fold_fullwidth), ("look_alike", fold_look_alikes), ("invisible", strip_invisible),
                     ("comment", strip_comments), ("space", fold_space), ("case", F.lower)):
        d = d.withColumn("_y", fn(F.col("_x"))).withColumn(f"_{name}", F.col("_y") != F.col("_x"))
        d = d.withColumn("transforms", F.col("transforms") + F.col(f"_{name}").cast("int")).drop("_x").withColumnRenamed("_y", "_x")
        flags.append(name)
    kinds = F.size("layers")
    d = d.withColumn("layers", labels(*[(F.col(f"_{n}"), n) for n in flags]))
    d = d.withColumn("complexity", F.least(F.lit(100), F.col("depth") * 8 + F.col("transforms") * 2 + kinds * 5
                                           + F.when(F.col("_base64"), 10).otherwise(0)))
    return d.withColumn("decoded", F.trim("_x")).drop("_x", *[f"_{n}" for n in flags])


def script_count(text: Column, ranges=SCRIPT_RANGES) -> Column:
    total = F.lit(0)
    for r in ranges:
        total = total + text.rlike(r).cast("int")
    return total


def printable_ratio(text: Column) -> Column:
    """Share of bytes that are not control characters other than tab and line ends."""
    n = F.octet_length(text)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")) / n)


def byte_entropy(text: Column) -> Column:
    """Shannon entropy in bits of the bytes of each text.

    Counting bytes needs a table of 256 counters per text, which no built-in holds; numpy
    does it over Arrow batches. Defined inside so that it travels to executors by value.
    """

    def entropy(texts: pd.Series) -> pd.Series:
        values = texts.to_numpy()
        out = np.zeros(len(values))
        at = 0
        while at < len(values):  # whole texts, about a megabyte and at most 512 rows a step
            raw, size = [], 0
            while at + len(raw) < len(values) and len(raw) < 512 and size < 1 << 20:
                t = values[at + len(raw)]
                raw.append(t.encode() if t is not None else b"")
                size += len(raw[-1])
            rows = len(raw)
            n = np.fromiter(map(len, raw), np.int64, rows)
            slot = np.repeat(np.arange(rows) * 256, n) + np.frombuffer(b"".join(raw), np.uint8)
            p = np.bincount(slot, minlength=256 * rows).reshape(-1, 256) / np.maximum(n, 1)[:, None]
            out[at : at + rows] = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(1)
            at += rows
        return pd.Series(out + 0.0, index=texts.index).where(texts.notna(), None)

    return F.pandas_udf(entropy, DoubleType())(text)


def entropy_of_counts(counts: Column) -> Column:
    """Shannon entropy in bits of an array of frequencies."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a - c / total * F.log2(c / total))


def ordinary_discount(text: Column) -> Column:
    """Entropy points to take off for encodings that are common in plain requests."""
    n = F.octet_length(text)
    cjk = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    escapes = F.regexp_count(text, F.lit("%[0-9a-fA-F]{2}"))
    harmless = ~url_decoded(text).rlike(r"[<>\"'%;|&`$(){}\\/*#=?!]")
    return points(
        (text.rlike(r"^[A-Za-z0-9+/=]+$") & (n % 4 == 0) & (F.regexp_count(text, F.lit("=")) <= 2), 30),
        ((escapes > 3) & (escapes / n > 0.3) & harmless, 20), (text.rlike(r"^\d+$"), 40),
        (text.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+$"), 25),
        (text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/?#]+[^\s]*$"), 20), ((cjk > 0) & (cjk / n > 0.3), 15),
        (text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), 35),
        (text.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}(?:\s+\d{2}:\d{2}(?::\d{2})?)?$"), 30))


def escape_depth(text: Column, passes: int = 12) -> Column:
    """How many times percent-decoding changes the text until it settles; ``passes`` is the limit for texts that never do."""
    def step(acc: Column, _: Column) -> Column:
        y = F.coalesce(F.try_url_decode(F.replace(acc["x"], F.lit("+"), F.lit("%2B"))), acc["x"])
        more = F.struct(y.alias("x"), (acc["depth"] + (y != acc["x"]).cast("int")).alias("depth"))
        return F.when(F.contains(acc["x"], F.lit("%")), more).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.struct(text.alias("x"), F.lit(0).alias("depth")), step)["depth"]


def feature_vector(text: Column, uri: Column, params: Column, risk: Column, entropy: Column) -> dict[str, Column]:
    """Twelve features of a request, each in 0..1; ``params`` is the parameter count."""
    n = F.octet_length(text)

    def ratio(x: Column) -> Column:
        return F.when(n > 0, x / n).otherwise(F.lit(0.0))

    def capped(x: Column, top: float) -> Column:
        return F.least(F.lit(1.0), x / F.lit(top))

    foreign = F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))
    path = F.regexp_extract(F.regexp_replace(uri, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    return {
        "payload_length": capped(n, 4096.0), "param_count": capped(params, 20.0), "entropy": capped(entropy, 8.0),
        "special_ratio": F.round(ratio(count_chars(text, SPECIALS)) * 100, 2) / 100,
        "numeric_ratio": ratio(count_chars(text, "0123456789")),
        "uppercase_ratio": ratio(count_chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "non_ascii_ratio": ratio(n - F.length(text) + foreign), "url_depth": capped(count_chars(uri, "/"), 10.0),
        "path_segments": capped(F.size(F.filter(F.split(path, "/"), lambda s: s != "")), 10.0),
        "query_params": capped(params, 20.0), "risk": capped(risk, 100.0), "encoding_depth": capped(escape_depth(text), 3.0),
    }


# Structural features of a payload. Counted characters, flag patterns, counted patterns.
COUNTED_CHARS = {
    "quote_count": "'\"", "paren_count": "()", "bracket_count": "<>", "semicolon_count": ";", "pipe_count": "|",
    "slash_count": "/", "backslash_count": "\\", "eq_count": "=",
}
FLAG_PATTERNS = {
    "has_or_keyword": r"(?i)\bOR\b", "has_and_keyword": r"(?i)\bAND\b", "has_union": r"(?i)\bUNION\b",
    "has_select": r"(?i)\bSELECT\b", "has_script": r"(?i)<script", "has_img": r"(?i)<img", "has_onerror": r"(?i)onerror",
    "has_onload": r"(?i)onload", "has_javascript": r"(?i)javascript:", "has_eval": r"(?i)eval\s*\(",
    "has_alert": r"(?i)alert\s*\(", "has_backtick": r"`", "has_dollar_paren": r"\$\(", "has_double_dash": r"--",
    "has_hash_comment": r"#", "has_like": r"(?i)\bLIKE\b", "has_into": r"(?i)\bINTO\b", "has_from": r"(?i)\bFROM\b",
    "has_where": r"(?i)\bWHERE\b", "has_etc_passwd": r"(?i)/etc/passwd", "has_etc_shadow": r"(?i)/etc/shadow",
    "has_htaccess": r"(?i)\.htaccess", "has_config_php": r"(?i)config\.php", "has_rm": r"(?i)\brm\s+-",
    "has_cat": r"(?i)\bcat\s+", "has_wget": r"(?i)\bwget\b", "has_curl": r"(?i)\bcurl\b", "has_bash": r"(?i)\bbash\b",
    "has_pipe_chain": r"(?i)\|\s*[a-z]", "has_percent_enc": r"%[0-9a-fA-F]{2}", "has_unicode_enc": r"(?i)%u[0-9a-fA-F]{4}",
}
COUNTED_PATTERNS = {"dotdot_count": r"\.\.", "tag_count": r"<[a-zA-Z]", "attr_count": r"\s[a-zA-Z-]+="}
DENSE_WORDS = ("(?i)\\b(?:OR|AND|UNION|SELECT|FROM|WHERE|INSERT|UPDATE|DELETE|DROP|EXEC|SCRIPT|EVAL|ALERT|ONERROR|ONLOAD|"
               "JAVASCRIPT)\\b")


def structural_features(text: Column) -> dict[str, Column]:
    """The 48 counts, shares and flags of a payload."""
    n = F.greatest(F.octet_length(text), F.lit(1))
    t, low = F.trim(text), F.lower(text)
    out: dict[str, Column] = {"length": F.octet_length(text)}
    # Whole bytes: a multi-byte character outside the kept set counts with all its bytes.
    out["special_ratio"] = F.octet_length(F.regexp_replace(text, r"[a-zA-Z0-9\s]+", "")) / n
    out.update({k: count_chars(text, c) for k, c in COUNTED_CHARS.items()})
    out["space_ratio"] = count_chars(text, " ") / n
    out.update({k: count_of(text, p) for k, p in COUNTED_PATTERNS.items()})
    out.update({k: matches(text, p, low).cast("int") for k, p in FLAG_PATTERNS.items()})
    out["keyword_density"] = count_of(text, DENSE_WORDS) / n * 100
    out["base64_like"] = ((F.octet_length(t) >= 20) & t.rlike(r"^[A-Za-z0-9+/=]+$") & (F.octet_length(t) % 4 == 0)).cast("int")
    out["hex_like"] = ((F.octet_length(t) >= 10) & t.rlike(r"^[0-9a-fA-F]+$")).cast("int")
    return out


RATIO_FEATURES = ["special_ratio", "space_ratio", "keyword_density"]

# String-joining shapes and characters that do not show.
CONCAT_SHAPES = [r"\.\s*\$", r"\$\w+\s*\.\s*[\"']", r"[\"']\s*\.\s*\$", r"(?i)concat\s*\(", r"(?i)group_concat\s*\("]
BROKEN_WORDS = [r"(?i)s/\*[\s\S]*?\*/e\s*l\s*e\s*c\s*t", r"(?i)un\s*/\*[\s\S]*?\*/i\s*o\s*n"]
INVISIBLE = "\u200b\u200c\u200d\ufeff\u2060\u00ad\u202a\u202b\u202c\u202d\u202e"
MIXED_RANGES = [r"[a-zA-Z]", r"[\x{0400}-\x{04FF}]", r"[\x{0370}-\x{03FF}]", r"[\x{0530}-\x{058F}]", r"[\x{0600}-\x{06FF}]",
                r"[\x{4E00}-\x{9FFF}]"]


def obfuscation(df: DataFrame, text: str, depth: Column, kinds: Column, double: Column, entropy: Column) -> DataFrame:
    """Adds ``obfuscation`` (0..100), ``obfuscation_depth``, ``techniques``, ``bypass_intent``.

    ``depth`` and ``kinds`` are the decoding depth and the number of encodings seen.
    """
    x, rest = F.col(text), F.col("_rest")

    def count(pattern: str, piece: str) -> Column:
        return F.when(~F.contains(x, F.lit(piece)), 0).otherwise(F.regexp_count(x, F.lit(pattern)))

    def found(pattern: str, piece: str | None) -> Column:
        return (F.contains(x, F.lit(piece)) & x.rlike(pattern) if piece else x.rlike(pattern)).cast("int")

    # characters beyond ASCII are told apart in what is left without the others
    d = df.withColumn("_rest", F.regexp_replace(x, r"[\x00-\x7F]+", "")).select(
        "*", (script_count(x, MIXED_RANGES[:1]) + script_count(rest, MIXED_RANGES[1:])).alias("_mixed"), count_chars(rest, INVISIBLE).alias("_inv"),
        (count(r"/\*[\s\S]*?\*/", "/*") + count(r"<!--[\s\S]*?-->", "<!--")).alias("_com"),
        count_runs(x, "[A-Z]").alias("_up"), count_runs(x, "[a-z]").alias("_lo"),
        F.regexp_count(rest, F.lit(r"[\x{0400}-\x{04FF}\x{0370}-\x{03FF}]")).alias("_alien"), count(r"\x00", "\x00").alias("_nul"),
        (count("0x[0-9a-fA-F]{4,}", "0x") + count(r"\\x[0-9a-fA-F]{2}", "\\x")).alias("_hex"),
        (F.octet_length(x) - F.octet_length(F.regexp_replace(x, r"\s+", ""))).alias("_ws"), F.octet_length(x).alias("_n"),
        sum((found(p, "$" if r"\$" in p else None) for p in CONCAT_SHAPES), F.lit(0)).alias("_cat"),
        sum((found(p, "/*") for p in BROKEN_WORDS), F.lit(0)).alias("_brk"), depth.alias("_d"), kinds.alias("_k"),
        double.alias("_2"), entropy.alias("_e"))
    c = F.col
    alpha = c("_up") + c("_lo")
    share = c("_up") / F.nullif(alpha, F.lit(0))
    look = (alpha > 10) & (c("_alien") > 0)
    case = F.coalesce((alpha > 20) & (share > 0.3) & (share < 0.7), F.lit(False))
    spaced = F.coalesce(c("_ws") / F.nullif(c("_n"), F.lit(0)) > 0.3, F.lit(False))
    score = points(
        (c("_d") >= 4, 30), (c("_d").between(2, 3), 15), (c("_k") >= 4, 15), (c("_k").between(2, 3), 8), (c("_2"), 25),
        (c("_mixed") >= 3, 20), (c("_mixed") == 2, 10), (look, 15), (c("_inv") >= 5, 15), (c("_inv").between(1, 4), 8),
        (c("_com") >= 3, 12), (c("_com").between(1, 2), 5), (case, 5), (spaced, 8), (c("_hex") >= 3, 18), (c("_hex").between(1, 2), 8),
        (c("_cat") >= 2, 15), (c("_cat") == 1, 8), (c("_brk") > 0, 20), ((c("_e") > 5.5) & (c("_n") > 30), 10),
    ) + F.least(F.lit(20), c("_nul") * 8)
    tech = labels(
        (c("_d") >= 2, "encoding_multilayer"), (c("_k") >= 4, "encoding_diversity"), (c("_2"), "double_encoding"),
        ((c("_mixed") >= 3) | look, "homoglyph"), (c("_inv") >= 5, "invisible_chars"), (c("_com") >= 3, "comment_injection"),
        (case, "case_mixing"), (spaced, "whitespace_injection"), (c("_hex") >= 3, "hex_obfuscation"), (c("_cat") >= 2, "string_concat"),
        (c("_brk") > 0, "structure_break"))
    d = d.withColumn("obfuscation", F.when(c("_n") == 0, 0).otherwise(F.least(F.lit(100), score)).cast("bigint")).withColumn("techniques", tech)
    s = c("obfuscation")
    risky = F.size(F.array_intersect("techniques", F.array(*[F.lit(t) for t in (
        "encoding_multilayer", "double_encoding", "structure_break", "homoglyph")])))
    d = d.withColumn("obfuscation_depth", first_of([(s >= 70, "extreme"), (s >= 50, "heavy"), (s >= 30, "moderate"), (s >= 10, "light")], "none"))
    return d.withColumn("bypass_intent", F.least(F.lit(100), risky * 20 + F.when(F.size("techniques") >= 4, 20).otherwise(0)).cast("bigint")) \
        .drop("_rest", "_mixed", "_inv", "_com", "_up", "_lo", "_alien", "_nul", "_hex", "_ws", "_n", "_cat", "_brk", "_d", "_k", "_2", "_e")
