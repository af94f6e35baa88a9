"""Small fixed tables: phases, chain templates, transition probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Attack phases in order.
CHAIN_PHASES = ["RECON", "SCAN", "ENUM", "INJECT", "EXPLOIT", "PERSIST", "EXFIL"]
DEEP_PHASES = ["INJECT", "EXPLOIT", "PERSIST", "EXFIL"]

# Coarse phases of one request, in order.
REQUEST_PHASES = ["none", "recon", "probe", "attempt", "attack", "exploit"]

# Kill-chain phases in order.
KILL_CHAIN = ["recon", "weaponization", "delivery", "exploitation", "installation", "c2", "actions"]

# Chain templates, (key, phases, risk).
CHAIN_TEMPLATES = [
    ("sql_injection_recon", ["RECON", "SCAN", "ENUM", "INJECT", "EXPLOIT", "EXFIL"], "critical"),
    ("xss_delivery", ["RECON", "SCAN", "INJECT", "EXPLOIT"], "high"),
    ("auth_bypass", ["RECON", "SCAN", "ENUM", "EXPLOIT"], "high"),
    ("path_traversal", ["RECON", "SCAN", "ENUM", "EXPLOIT"], "high"),
    ("webshell_deploy", ["RECON", "SCAN", "INJECT", "EXPLOIT", "PERSIST"], "critical"),
    ("lateral_movement_chain", ["RECON", "SCAN", "INJECT", "EXPLOIT", "PERSIST", "EXFIL"], "critical"),
    ("ssrf_to_rce_chain", ["RECON", "SCAN", "INJECT", "EXPLOIT", "PERSIST"], "high"),
    ("credential_stuffing_chain", ["RECON", "SCAN", "ENUM", "INJECT"], "high"),
]

# Transition probabilities, one row per source phase, columns in phase order.
CHAIN_TRANSITIONS = {
    "RECON": [0.40, 0.40, 0.15, 0.04, 0.01, 0.00, 0.00],
    "SCAN": [0.10, 0.35, 0.30, 0.20, 0.04, 0.01, 0.00],
    "ENUM": [0.05, 0.10, 0.30, 0.40, 0.13, 0.01, 0.01],
    "INJECT": [0.02, 0.03, 0.10, 0.30, 0.45, 0.08, 0.02],
    "EXPLOIT": [0.01, 0.02, 0.03, 0.10, 0.30, 0.45, 0.09],
    "PERSIST": [0.01, 0.01, 0.02, 0.05, 0.15, 0.40, 0.36],
    "EXFIL": [0.01, 0.01, 0.01, 0.03, 0.05, 0.15, 0.74],
}
KILL_CHAIN_TRANSITIONS = {
    "recon": [0.30, 0.70, 0.15, 0.15, 0.05, 0.05, 0.05],
    "weaponization": [0.10, 0.30, 0.70, 0.15, 0.15, 0.05, 0.05],
    "delivery": [0.05, 0.10, 0.30, 0.70, 0.15, 0.15, 0.05],
    "exploitation": [0.10, 0.05, 0.10, 0.30, 0.70, 0.15, 0.15],
    "installation": [0.05, 0.05, 0.05, 0.10, 0.30, 0.70, 0.15],
    "c2": [0.05, 0.05, 0.05, 0.05, 0.10, 0.30, 0.70],
    "actions": [0.10, 0.05, 0.05, 0.05, 0.05, 0.10, 0.30],
}

# Known changes of intent, (from, to, probability).
INTENT_TRANSITIONS = [
    ("sql_injection", "path_traversal", 0.4),
    ("sql_injection", "code_execution", 0.3),
    ("xss", "command_injection", 0.2),
    ("path_traversal", "code_execution", 0.5),
    ("code_execution", "command_injection", 0.6),
]


def chain_pairs() -> list[tuple[str, str, float]]:
    return [(a, b, p) for a, row in CHAIN_TRANSITIONS.items() for b, p in zip(CHAIN_PHASES, row)]


def kill_chain_pairs() -> list[tuple[str, str, float]]:
    return [(a, b, p) for a, row in KILL_CHAIN_TRANSITIONS.items() for b, p in zip(KILL_CHAIN, row)]


def transition_table(spark: SparkSession, pairs: list[tuple[str, str, float]]) -> DataFrame:
    """(from_phase, to_phase, p): at most a few dozen rows, fit for a broadcast."""
    return spark.createDataFrame(pairs, "from_phase string, to_phase string, p double")


def values_sql(rows: list[tuple]) -> str:
    """Rows as a VALUES list for the checking SQL."""

    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "NULL" if v is None else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)

# Likely next paths after a phase, (phase, path, probability in percent).
NEXT_PATHS = [
    ("recon", "/robots.txt", 85), ("recon", "/sitemap.xml", 70), ("recon", "/.git/", 65), ("recon", "/.svn/", 50),
    ("recon", "/phpinfo.php", 60), ("recon", "/admin/", 55), ("recon", "/wp-admin/", 50), ("recon", "/pma/", 45),
    ("recon", "/info.php", 40), ("recon", "/config.php", 35),
    ("probe", "?id=1", 90), ("probe", "?id=1%27", 85), ("probe", "?id=1%20or%201=1", 80),
    ("probe", "?id=1%20union%20select", 75), ("probe", "../etc/passwd", 65), ("probe", "?cmd=whoami", 60),
    ("probe", "<script>alert(1)</script>", 70), ("probe", "?file=index.php", 55),
    ("attempt", "?id=1 union select 1,2,3", 85), ("attempt", "?id=1 union select 1,version(),3", 80),
    ("attempt", "?id=1 union select 1,group_concat(table_name),3", 75),
    ("attempt", "?id=1 union select 1,group_concat(column_name),3", 70), ("attempt", "?id=1 sleep(5)", 65),
    ("attempt", "?id=1 updatexml(1,concat(0x7e,version()),1)", 60), ("attempt", "?file=../../etc/passwd", 70),
    ("attempt", "?cmd=ls%20-la", 60),
    ("attack", "/admin/login.php", 85), ("attack", "/wp-admin/admin-ajax.php", 70), ("attack", "/phpmyadmin/", 65),
    ("attack", "/uploads/", 60), ("attack", "/shell.php", 80), ("attack", "/backdoor.php", 75),
    ("exploit", "/etc/passwd", 90), ("exploit", "/root/.ssh/id_rsa", 80), ("exploit", "/var/www/html/config.php", 75),
    ("exploit", "/etc/cron.d/", 70), ("exploit", "/proc/self/environ", 65), ("exploit", "/dev/tcp/", 60),
]

# Likely next parameters after a phase, (phase, name, probability in percent).
NEXT_PARAMS = [
    ("recon", "id", 80), ("recon", "page", 70), ("recon", "file", 60), ("recon", "url", 55), ("recon", "action", 50),
    ("probe", "id", 95), ("probe", "search", 75), ("probe", "q", 70), ("probe", "username", 65), ("probe", "email", 60),
    ("attempt", "id", 95), ("attempt", "username", 80), ("attempt", "password", 75), ("attempt", "file", 70),
    ("attempt", "url", 65),
    ("attack", "admin", 85), ("attack", "token", 80), ("attack", "session", 75), ("attack", "user_id", 70),
    ("exploit", "cmd", 95), ("exploit", "exec", 90), ("exploit", "eval", 85),
]
