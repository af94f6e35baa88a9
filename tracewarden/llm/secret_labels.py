"""A small labelled table of findings: made-up secrets and strings that only look like ones, in made-up context.

Every value is random; nothing is taken from the tables that are scanned. Formats of keys follow what
their issuers publish (prefix and length).
"""

from __future__ import annotations

import base64
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ROWS, SEED = 6000, 20
_ALNUM = string.ascii_letters + string.digits
_WORDS = (
    "a the of and to in for is on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has search free but our one other do no information time they site he up may what "
    "which their news out use any there see only so his when contact here business who web also now help get view online first been would how were services some these click its like service than find price date back top people had list name just over state year "
    "der die und das ist nicht ein eine mit auf für von werden haben sich als auch nach wie aus bei oder nur noch über la le les des une est pas pour que dans sur avec plus par el los las una por para como más pero sus este"
).split()
_NAMES = "user id build part item order chapter section module test case page image photo report invoice version release figure table model series route line file column index name value type state mode group level version node host".split()


class _Maker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def count(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high + 1))

    def prose(self, most: int) -> str:
        return " ".join(self.one(_WORDS) if self.rng.random() < 0.7 else self.pseudo() for _ in range(self.count(0, most)))

    def pseudo(self) -> str:
        return "".join(self.chars("bcdfghjklmnprstvwz", 1) + self.chars("aeiou", 1) + self.one(["", "n", "r", "st", "ng"]) for _ in range(self.count(1, 4)))

    def secret(self) -> str:
        r = self.rng.random()
        raw = lambda n: base64.b64encode(self.rng.bytes(n)).decode()
        if r < 0.2:
            return raw(self.count(15, 60))
        if r < 0.45:
            return self.chars(_ALNUM, self.count(16, 64))
        if r < 0.55:
            return self.one(["ghp_", "gho_", "ghs_"]) + self.chars(_ALNUM, 36)
        if r < 0.62:
            return self.one(["sk_live_", "rk_live_", "pk_live_"]) + self.chars(_ALNUM, 24)
        if r < 0.69:
            return self.one(["xoxb-", "xoxp-"]) + self.chars(string.digits, 12) + "-" + self.chars(string.digits, 12) + "-" + self.chars(_ALNUM, 24)
        if r < 0.76:
            return "AIza" + self.chars(_ALNUM + "-_", 35)
        if r < 0.84:
            return "eyJ" + raw(self.count(15, 40)).replace("+", "-").replace("/", "_").rstrip("=") + "." + raw(30).replace("+", "-").replace("/", "_") + "." + raw(24).rstrip("=").replace("/", "_")
        if r < 0.92:
            return self.chars("0123456789ABCDEF", self.one([32, 40, 64]))
        return self.chars(string.ascii_lowercase + string.digits, self.count(20, 48))

    def harmless(self) -> str:
        r = self.rng.random()
        digits = lambda a, b: self.chars(string.digits, self.count(a, b))
        words = lambda a, b: [self.one(_WORDS) if self.rng.random() < 0.5 else self.pseudo() for _ in range(self.count(a, b))]
        if r < 0.14:
            return f"www.{self.pseudo()}{self.one(['', digits(1, 3)])}.{self.one(['com', 'org', 'net', 'example'])}/{'/'.join(words(1, 4))}/{digits(1, 6)}"
        if r < 0.24:
            return f"{'_'.join(words(2, 4))}_{digits(1, 4)}.{self.one(['html', 'txt', 'csv', 'png', 'pdf', 'py'])}"
        if r < 0.34:
            return f"{self.one(_NAMES)}_{self.one(_NAMES)}_{self.pseudo()}{digits(1, 5)}"
        if r < 0.42:
            return f"20{digits(2, 2)}-{digits(2, 2)}-{digits(2, 2)}T{digits(2, 2)}.{digits(2, 6)}Z"
        if r < 0.5:
            return f"v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}-{self.one(['alpha', 'beta', 'rc', 'release'])}.{digits(1, 4)}+{self.pseudo()}"
        if r < 0.6:
            return "".join(w.capitalize() for w in words(3, 6)) + digits(1, 3)
        if r < 0.68:
            return f"{self.pseudo()}.{self.pseudo()}{digits(2, 4)}.{self.pseudo()}.{self.one(['example', 'mail', 'com'])}"
        if r < 0.76:
            return "-".join(words(3, 6)) + "-" + digits(1, 6)
        if r < 0.82:
            return "-".join(self.chars("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        if r < 0.88:
            return f"{self.one(['SKU', 'ISBN', 'DIN', 'ISO', 'EAN', 'No'])}-{digits(4, 8)}-{digits(2, 5)}-{self.one('ABX')}{digits(1, 3)}"
        if r < 0.94:
            return "".join(words(4, 8)) + self.one(["", digits(1, 2)]) + self.one(["=", "+", "-", "."]) + "".join(words(1, 3)) + digits(1, 3)
        return f"{self.one(['x', 'y', 'n'])}{digits(1, 1)}+{self.one('abc')}{digits(1, 2)}={digits(1, 3)}/{self.pseudo()}_{digits(5, 9)}"

    def finding(self, secret: bool) -> tuple[str, int, int, bool]:
        value = self.secret() if secret else self.harmless()
        lead = ["", "", " ", "\n", "(", '"', "= ", ": ", "-> ", "`", ", "]
        if secret and self.rng.random() < 0.5:
            lead = [f"{self.one(['key', 'auth', 'Bearer', 'credential', 'pwd', 'pass', 'private key', 'signature', 'access', 'client'])}{x}" for x in (" ", "=", ": ", " = '", '": "')]
        elif self.rng.random() < 0.4:
            lead = [f"{self.one(_NAMES)}{x}" for x in (" ", "=", ": ", " = ", " #")]
        before = self.prose(8) + self.one([" ", " ", "\n", ". "]) + self.one(lead)
        after = self.one([" ", "\n", '" ', "', ", ") ", ". ", ""]) + self.prose(5)
        return before + value + after, len(before), len(before) + len(value), secret


def labelled_findings(spark: SparkSession, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """text, start, end (code points), secret: one row in two is a secret."""
    make = _Maker(seed)
    return spark.createDataFrame([make.finding(k % 2 == 0) for k in range(rows)], "text string, start int, end int, secret boolean")
