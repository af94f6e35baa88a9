"""Naive Bayes text model kept as tables: (class, n) and (class, token, n)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of
from tracewarden.functions.text import matches

#: Bytes of text that are cut up at a time, and most tokens of a model that are sent to all tasks.
STEP, BROADCAST = 1 << 20, 200_000

# Marker tokens and the patterns that set them.
MARKERS = [
    ("__sql_keyword__", r"\b(?:union|select|insert|delete|drop|update|alter|create)\b"),
    ("__xss_pattern__", r"<script|javascript:|on\w+\s*=|eval\s*\("),
    ("__path_trav__", r"\.\.[/\\]|/etc/|/proc/|php://|file://"),
    ("__cmd_exec__", r"\b(?:system|exec|shell_exec|passthru|popen|proc_open)\s*\("),
    ("__ssti_pattern__", r"\{\{.*\}\}|<%.*%>|\$\{.*\}"),
    ("__internal_ip__", r"169\.254\.|10\.0\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|localhost"),
    ("__obfuscation__", r"base64_decode|str_rot13|gzinflate|strrev"),
]


def _shaped(df: DataFrame, keep: Sequence[str | Column], text: str) -> DataFrame:
    """(keep.., _t, _m): the lower-case texts that are not empty, and their markers as bits."""
    d = df.select(*keep, F.lower(F.trim(text)).alias("_t")).filter(F.col("_t") != "")
    t, bits = F.col("_t"), F.lit(0)
    for i, (_, p) in enumerate(MARKERS):
        bits = bits + F.when(matches(t, p, t), 1 << i).otherwise(0)
    return d.withColumn("_m", bits.cast("int")).withColumn("_t", t.cast("binary"))


def _counter():
    """Functions that count tokens in Arrow batches; defined inside so that they travel to executors by value."""
    markers, step = [m for m, _ in MARKERS], STEP

    def grams(texts: list[str], owner: np.ndarray, k: int):
        """(owner, gram, n) of all runs of k characters, added up by owner."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        used, least = np.flatnonzero(np.bincount(code)), owner.min()
        size = len(used)
        if int(owner.max() - least + 1) * size**k >= 1 << 63:  # the numbers of the grams would not fit
            order = np.argsort(owner, kind="stable")
            for half in np.array_split(order, [np.searchsorted(owner[order], (owner.max() + least + 1) // 2)]):
                yield from grams([texts[i] for i in half], owner[half], k)
            return
        place = np.zeros(int(used[-1]) + 1, np.int64)
        place[used] = np.arange(size)
        code = place[code]
        at = np.flatnonzero(np.repeat(np.cumsum(n), n) - np.arange(len(code)) >= k)
        key = np.repeat(owner - least, n)[at]
        for i in range(k):
            key = key * size + code[at + i]
        key, count = np.unique(key, return_counts=True)
        char = np.empty((len(key), k), "<u4")
        for i in reversed(range(k)):
            key, c = np.divmod(key, size)
            char[:, i] = used[c]
        ends = np.cumsum((1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)).sum(1))
        data = char.tobytes().decode("utf-32-le").encode()
        yield key + least, pa.StringArray.from_buffers(len(key), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)), count

    def whole(column: pa.Array, marks: np.ndarray, owner: np.ndarray):
        """(owner, token, n) with one row for each; equal owners lie together."""
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        size = np.add.reduceat(pc.binary_length(column).to_numpy(), first) if len(first) else first
        big = np.isin(owner, owner[first[size > step]])
        small = np.flatnonzero(~big)
        if len(small):
            cuts = np.searchsorted(np.cumsum(size[size <= step]) // step, np.arange(1, int(size[size <= step].sum()) // step + 1))
            for part in np.array_split(small, np.searchsorted(owner[small], owner[first[size <= step]][cuts])):
                yield from counted(column.take(pa.array(part)), marks[part], owner[part], 1 << 62)
        for o in owner[first[size > step]].tolist():
            part = np.flatnonzero(owner == o)
            rows = [pa.table({"t": t, "n": n}) for _, t, n in counted(column.take(pa.array(part)), marks[part], owner[part], step)]
            rows = pa.concat_tables(rows).group_by("t").aggregate([("n", "sum")]).combine_chunks()
            yield np.full(len(rows), o), pa.concat_arrays(rows["t"].chunks), rows["n_sum"].to_numpy()

    def counted(column: pa.Array, marks: np.ndarray, owner: np.ndarray, step: int = step):
        """(owner, token, n) of all tokens, added up by owner within some megabytes of text."""
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            texts = [t.decode("utf-8", "replace") for t in column.slice(at, end - at).to_pylist()]
            long = np.fromiter((len(t) >= 4 for t in texts), bool, len(texts))
            own, bits = owner[at:end], np.where(long, marks[at:end], 0)
            if long.any():
                kept = [t for t, x in zip(texts, long.tolist()) if x]
                for k in (2, 3):
                    yield from grams(kept, own[long], k)
            few = Counter((o, t) for o, t, x in zip(own.tolist(), texts, long.tolist()) if not x)
            for i, m in enumerate(markers):
                few.update((o, m) for o in own[bits >> i & 1 == 1].tolist())
            if few:
                yield np.array([o for o, _ in few]), pa.array([t for _, t in few], pa.string()), np.array(list(few.values()))
            at = end

    def batch(schema: list[str], columns: list[pa.Array], own: np.ndarray, token: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        rows = pa.array(own)
        return pa.RecordBatch.from_arrays([*[c.take(rows) for c in columns], token, pa.array(n.astype(np.int64))], [*schema, "token", "n"])

    return counted, whole, batch


def token_counts(df: DataFrame, ids: Sequence[str], text: str, parts: int | None = None) -> DataFrame:
    """(ids, token, n): character pairs, triples and markers of the lower-case text with their numbers.

    A text of under four characters is one token. The texts are spread by id before they are cut up, so
    what crosses the network is the text and not its many tokens; texts of equal ids count as one.
    """
    spread = df.repartition(*ids) if parts is None else df.repartition(parts, *ids)
    rows = _shaped(spread, ids, text).groupBy(*ids).agg(F.collect_list(F.struct("_t", "_m")).alias("_l"))
    names = list(ids)
    _, whole, batch = _counter()

    def run(batches):
        for b in batches:
            lists = b.column("_l")
            flat, own = lists.flatten(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            for x in whole(flat.field("_t"), flat.field("_m").to_numpy(), own):
                yield batch(names, [b.column(c) for c in names], *x)

    schema = rows.select(*ids).schema.add("token", "string").add("n", "long")
    return rows.mapInArrow(run, schema)


def train(df: DataFrame, text: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Class counts and token counts per class; texts without a token are left out.

    Tokens are counted in the map tasks; one row per class and distinct token is shuffled.
    """
    used = df.filter(F.trim(text) != "")
    rows = _shaped(df, [F.col(label).alias("class")], text)
    counted, _, batch = _counter()

    def run(batches):
        for b in batches:
            classes = b.column("class").dictionary_encode("encode")
            for x in counted(b.column("_t"), b.column("_m").to_numpy(), classes.indices.to_numpy().astype(np.int64)):
                yield batch(["class"], [classes.dictionary], *x)

    tokens = rows.mapInArrow(run, rows.select("class").schema.add("token", "string").add("n", "long"))
    tokens = tokens.groupBy("class", "token").agg(F.sum("n").alias("n"))
    return used.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n")), tokens


def store(model: tuple[DataFrame, DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """Writes the model's tables. Read back, Spark knows their size and broadcasts only small ones."""
    out = []
    for name, df in zip(("classes", "tokens"), model):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out.append(df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}"))
    return out[0], out[1]


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of two models added up."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))


def score(df: DataFrame, ids: Sequence[str], text: str, classes: DataFrame, tokens: DataFrame, attack: str = "attack", normal: str = "normal",
          cold: int = 10, warm: int = 20) -> DataFrame:
    """Probability, confidence and score of the attack class per text.

    With under ``cold`` training texts the class is unknown, under ``warm`` the score is 0.
    Totals are two one-row subqueries; the model joins by token, one row per token. The model's most
    frequent tokens go to all tasks, so that a token of every text brings no rows together.
    """
    def of(c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0))

    model = tokens.groupBy("token").agg(F.sum(F.when(F.col("class") == attack, F.col("n")).otherwise(0)).alias("a"),
                                        F.sum(F.when(F.col("class") == normal, F.col("n")).otherwise(0)).alias("b"))
    totals = model.agg(F.struct(F.greatest(F.count("*"), F.lit(1)).alias("v"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"),
                                F.coalesce(F.sum("b"), F.lit(0)).alias("b"))).scalar()
    texts = classes.agg(F.struct(of(attack).alias("a"), of(normal).alias("b"))).scalar()
    t = token_counts(df, ids, text)
    if model.count() <= BROADCAST:
        t = t.join(F.broadcast(model), "token", "left")
    else:
        often = F.broadcast(model.orderBy(F.desc(F.col("a") + F.col("b")), "token").limit(BROADCAST))
        rare = t.join(often, "token", "left_anti").join(model, "token", "left")
        t = t.join(often, "token").unionByName(rare)
    t = t.na.fill(0, ["a", "b"])
    t = t.withColumn("_m", totals).withColumn("_da", F.col("_m.a") + F.col("_m.v")).withColumn("_db", F.col("_m.b") + F.col("_m.v"))
    g = t.groupBy(*ids).agg(
        F.sum(F.col("n") * F.log((F.col("a") + 1) / F.col("_da"))).alias("la"), F.sum(F.col("n") * F.log((F.col("b") + 1) / F.col("_db"))).alias("lb"),
        F.count_if((F.col("a") > 0) | (F.col("b") > 0)).alias("hit"), F.sum("n").alias("total"))
    g = g.withColumn("_x", texts).withColumn("_na", F.col("_x.a")).withColumn("_nb", F.col("_x.b"))
    c = F.col
    n = c("_na") + c("_nb")
    la, lb = c("la") + F.log((c("_na") + 1) / (n + 2)), c("lb") + F.log((c("_nb") + 1) / (n + 2))
    g = g.withColumn("_d", lb - la).withColumn("_n", n)
    p = F.when(c("_n") < cold, 0.5).otherwise(1 / (1 + F.exp(F.least(c("_d"), F.lit(700.0)))))
    g = g.withColumn("probability", F.round(p, 4)).withColumn("match", c("hit") / c("total"))
    conf = F.abs(c("probability") - 0.5) * 2 * F.when(c("match") < 0.1, 0.5).otherwise(1.0)
    g = g.withColumn("confidence", F.when(c("_n") < cold, 0.0).otherwise(F.round(conf, 4)))
    return g.select(
        *ids, first_of([(c("_n") < cold, "unknown"), (c("probability") > 0.5, attack)], normal).alias("class"), "probability", "confidence", "match",
        F.when(c("_n") < warm, 0.0).otherwise(F.round(F.least(F.lit(100.0), c("probability") * 100 * c("confidence")), 1)).alias("score"))
