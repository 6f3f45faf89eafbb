"""Language-model scores by a gated recurrent network (gru.py), trained in Spark.

*   Words are counted over all training documents (`counts`: one row for each word, as many
    as the corpus has; they stay distributed).
*   The words at or above a frequency that leaves at most `HEAD` of them, a bounded table, go
    to every task; the `WORDS` most frequent of them are the network's vocabulary, in classes
    of `PER_CLASS`.  The frequency comes from a histogram of some hundred cells.
*   Training documents become ids, two bytes a token, written to the shared folder, and are
    dealt by a hash of id and text into rounds and into shards of about `SHARD_TOKENS`.  In each
    of `ROUNDS` rounds every shard of the round trains a copy of the network, by truncated
    backpropagation over its documents in the order of their hashes; the copies are averaged by
    their tokens, coordinate by coordinate, in an aggregation.  Each training document is learnt
    from once.  Shards depend on the table alone, not on the cluster or on how its rows are
    dealt, so scores can be had again (but for the order of sums, a relative 1e-6 or so).
*   Scoring carries the state through each whole document.  A word outside the vocabulary costs
    its class's probability and its share of that class: (c + 0.5) / (n + 0.5 (v + 1)), with c
    its count, n and v the tokens and words of the class.  Words outside the head get their
    counts by a join with `counts`, so every count is exact.

Null and empty texts are the end mark alone; a null id counts as the empty text for the
held-out test; every row gives a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, gru
from . import text as tx

HEAD = 1 << 18
WORDS, PER_CLASS, SIZE = 1024, 32, 16
ROUNDS = 4
#: Tokens of a shard: as many as one copy learns from in a round.
SHARD_TOKENS = 1 << 20
#: Tokens that a worker lays out in lanes at a time: a shard, or part of an uneven one.  In smaller
#: parts a long document's lane outlasts the others, and most windows hold few lanes.
CHUNK_TOKENS = SHARD_TOKENS
#: Text that a worker scores or learns from at a time.
CHUNK_BYTES = 8 << 20
END = np.int64(0x5EED0FE2D)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words, an end mark after each document's; offsets)."""
    data, offsets = tx.utf8(batch.column("text"))
    starts, ends, first = tx.words(data, offsets)
    h = tx.span_hash(data, starts, ends, lower=True).view(np.int64)
    n = np.diff(first) + 1
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.full(at[-1], END, np.int64)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = False
    out[keep] = h
    return out, at


def chunks(batches):
    """Record batches of about CHUNK_BYTES of text."""
    held, size = [], 0
    for batch in common.slices(batches):
        held.append(batch)
        size += batch.column(batch.schema.get_field_index("text")).nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): hash and count of each word of docs, the end mark included."""

    def count(batches):
        for batch in common.slices(batches):
            w, c = np.unique(tokens(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c)], ["w", "c"])

    return common.mapped(docs.select("text"), count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts(w, c) in the highest cells of a histogram of log counts that hold at
    most so many rows together; a sorted limit would send each task's to the driver."""
    cell = F.floor(F.log2("c") * 16)
    cells = sorted(((r[0], r[1]) for r in counts.groupBy(cell.alias("cell")).count().collect()), reverse=True)
    least, total = None, 0
    for name, n in cells:  # a cell for each sixteenth of a doubling: a thousand at most
        total += n
        if total > most:
            break
        least = name
    return counts.where(cell >= least) if least is not None else counts.where("false")


class Head:
    """The most frequent words: hashes in order, their counts, and their place in the network."""

    def __init__(self, w: np.ndarray, c: np.ndarray, words: int, n_tokens: int, n_types: int):
        place = np.full(len(w), words, np.int64)
        place[:words] = np.arange(min(words, len(w)))  # w and c come by falling count
        order = np.argsort(w)
        self.w, self.c, self.place = w[order], c[order], place[order]
        inner = order[order < words]
        self.inner = w[inner], inner  # the vocabulary alone, by hash
        self.end = int(self.place[np.searchsorted(self.w, END)]) if len(w) else 0
        inside = int(c[:words].sum())
        self.n_tokens, self.n_types = n_tokens, n_types
        self.base_total = np.log10(n_tokens + 0.5 * (n_types + 1))
        self.rest_tokens = n_tokens - inside
        self.rest_total = np.log10(self.rest_tokens + 0.5 * (max(0, n_types - words) + 1))

    def find(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in the head, whether it is there)."""
        if not len(self.w):
            return np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        at = np.minimum(np.searchsorted(self.w, t), len(self.w) - 1)
        return at, self.w[at] == t

    def inner_ids(self, t: np.ndarray, words: int) -> np.ndarray:
        """Places in the network; `words` for all others."""
        w, place = self.inner
        if not len(w):
            return np.full(len(t), words)
        at = np.minimum(np.searchsorted(w, t), len(w) - 1)
        return np.where(w[at] == t, place[at], words)

    def ids(self, at: np.ndarray, there: np.ndarray, words: int) -> np.ndarray:
        return np.where(there, self.place[at], words) if len(self.w) else np.full(len(at), words)


def _averaged(copies: DataFrame, like: dict) -> dict:
    """The mean of copies(n, weights) by n: an aggregation of a row for each parameter."""
    mean = (
        copies.select("n", F.posexplode("weights").alias("i", "x"))
        .groupBy("i")
        .agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("x"))
    )
    rows = mean.toPandas().sort_values("i")
    return gru.shaped(rows["x"].to_numpy(), like) if len(rows) else like


def _coded(docs: DataFrame, head, words: int, rounds: int, shards: int) -> DataFrame:
    """(round, shard, key, ids) of each of docs(doc_id, text): ids as little-endian 16-bit."""

    def code(batches):
        own = head.value
        for batch in chunks(batches):
            t, offsets = tokens(batch)
            raw = own.inner_ids(t, words).astype("<u2").tobytes()
            ids = [raw[a:b] for a, b in zip((2 * offsets[:-1]).tolist(), (2 * offsets[1:]).tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("round", "shard", "key")), pa.array(ids, pa.binary())], ["round", "shard", "key", "ids"])

    key = F.xxhash64("doc_id", "text")
    round_ = F.pmod(key, F.lit(rounds)).cast("int")
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    keyed = docs.select("text", key.alias("key"), round_.alias("round"), shard.alias("shard"))
    return common.written(common.mapped(keyed, code, "round int, shard int, key long, ids binary"), "round")


def _shards(batches):
    """(shard, tokens, offsets) of about CHUNK_TOKENS at a time, from rows in order of shards."""
    held: list[bytes] = []
    size, now = 0, None

    def joined():
        lengths = np.array([len(x) // 2 for x in held])
        return now, np.frombuffer(b"".join(held), "<u2").astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])

    for batch in batches:
        for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
            if held and (shard != now or size >= CHUNK_TOKENS):
                yield joined()
                held, size = [], 0
            now = shard
            held.append(ids)
            size += len(ids) // 2
    if held:
        yield joined()


def trained(docs: DataFrame, head, words: int, per_class: int, size: int, rounds: int) -> dict:
    """The network's parameters, after each of docs(doc_id, text) was learnt from once."""
    top = np.zeros(words)
    inside = head.value.place < words
    top[head.value.place[inside]] = head.value.c[inside]
    p = gru.fresh(top, head.value.rest_tokens, size, per_class)
    coded = _coded(docs, head, words, rounds, max(1, -(-head.value.n_tokens // (rounds * SHARD_TOKENS))))
    for r in range(rounds):
        start = p

        def learn(batches):
            def copy(trainer):
                weights = common.lists(gru.flat(trainer.model.p), np.array([0, gru.flat(start).size]))
                return pa.RecordBatch.from_arrays([pa.array([trainer.seen]), weights], ["n", "weights"])

            trainer, now = None, None
            for shard, t, offsets in _shards(batches):
                if shard != now:
                    if trainer:
                        yield copy(trainer)
                    trainer, now = gru.Trainer(start), shard
                trainer.learn(t, offsets, head.value.end)
            if trainer:
                yield copy(trainer)

        part = coded.where(F.col("round") == r).select("shard", "key", "ids").repartition("shard").sortWithinPartitions("shard", "key")
        p = _averaged(common.mapped(part, learn, "n long, weights array<float>"), p)
    common.dropped(coded)
    return p


def scores(
    docs: DataFrame, head_size: int = HEAD, words: int = WORDS, per_class: int = PER_CLASS, size: int = SIZE, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = common.named(docs, doc_id="doc_id", text="text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    train = docs.where(~held_out)
    counts = common.written(word_counts(train))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = _frequent(counts, head_size).toPandas().sort_values(["c", "w"], ascending=[False, True])
    w, c = top["w"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    if int(total["n"]) and END not in w[:words]:  # the end mark is always in the vocabulary
        at = np.flatnonzero(w == END)
        c_end = c[at[0]] if len(at) else counts.where(F.col("w") == int(END)).first()["c"]
        keep = w != END
        w, c = np.concatenate([[END], w[keep]]), np.concatenate([[c_end], c[keep]])
    head = spark.sparkContext.broadcast(Head(w, c, words, int(total["n"]), int(total["v"])))
    p = trained(train, head, words, per_class, size, rounds) if len(w) else gru.fresh(np.zeros(words), 0, size, per_class)
    network = spark.sparkContext.broadcast(p)

    def score(batches):
        own, model = head.value, gru.Model(network.value)
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 36
        for batch in chunks(batches):
            t, offsets = tokens(batch)
            at, there = own.find(t)
            ids = own.ids(at, there, words)
            log = np.zeros(len(t))
            if len(own.w):
                log[there] = np.log10(own.c[at[there]] + 0.5)
            n = np.diff(offsets)
            base = np.add.reduceat(log, offsets[:-1])
            outside = ids == words
            lm = model.log_likelihood(ids, offsets, own.end) / np.log(10)
            lm[outside] += log[outside] - own.rest_total
            lm = np.add.reduceat(lm, offsets[:-1])
            known = np.add.reduceat(there.astype(np.int64), offsets[:-1])
            far = np.flatnonzero(~there)
            doc = np.searchsorted(offsets, far, "right") - 1
            far_at = np.searchsorted(doc, np.arange(len(n) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + len(n))),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(n),
                    pa.array(known),
                    pa.array(base - n * own.base_total),
                    pa.array(lm),
                    common.lists(t[far], far_at),
                ],
                ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "far"],
            )
            uid += len(n)

    near = common.written(
        common.mapped(
            docs.withColumn("held_out", held_out).select("doc_id", "held_out", "text"),
            score,
            "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, far array<long>",
        )
    )
    far = (
        near.select("uid", F.explode("far").alias("w"))
        .groupBy("uid", "w")
        .agg(F.count("*").alias("k"))
        .join(counts.hint("merge"), "w", "left")
        .select("uid", "k", F.coalesce("c", F.lit(0)).alias("c"))
        .groupBy("uid")
        .agg(F.sum(F.col("k") * F.log10(F.col("c") + 0.5)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("known"))
    )
    far = far.select("uid", F.col("log"), F.coalesce("known", F.lit(0)).alias("known"))
    zero = lambda name, kind: F.coalesce(F.col(name), F.lit(0).cast(kind))
    return near.join(far, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("known", "long")).alias("n_known"),
        F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("log", "double")).alias("base_score"),
        (F.col("score") + zero("log", "double")).alias("score"),
    )


def op8_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
