"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard similarity.

1.  Each text becomes its set of word shingles, a 128-bit fingerprint of the set and a
    circulant MinHash signature (minhash.py): two permutations give all coordinates.
2.  Equal sets are one representative from there on, so a group of copies of any size
    costs a partial aggregation.
3.  Bands of the signature are bucket keys.  One byte of each coordinate estimates
    similarity.  The member that shares most over all of its buckets is a bucket's hub, so a
    group's buckets mostly have the same one, and each text first joins the first of its
    hubs, which gives a row for a text, however many buckets it is in.  In a bucket of up to
    about `block` rows, members without a leader join the first one there that they
    resemble.  Members that might be linked across leaders fall into one *neighbourhood*, by
    a row for their leaders.  In a larger bucket the hub leads all that resemble it, by one
    join; only the others are then compared with all of the bucket, in cells of two blocks.
4.  Leaders and members are confirmed on their full sets, and components are found.
5.  A neighbourhood of several components (few are) is compared in full: members outside its
    largest component with all others, in cells where it is large, and a set's intersections
    with all sets of a cell are counted at once.  Only links come out, so no link inside
    a bucket is lost and no list of pairs is made.

With 40 bands of 5 rows a pair at similarity 0.75 meets no bucket with probability 2e-5,
at 0.8 with 1e-7; an estimate 0.2 below the threshold is more than six deviations off.

Nulls and empty texts have empty sets and are linked with nothing.  Repeated ids keep their
rows, each classed by its own text.  A row with a null id has a null component.  An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, minhash
from . import text as tx

BANDS, ROWS = 40, 5
PERCENT = 75
#: How far below the threshold an estimate still makes two members neighbours.
MARGIN = 0.20
BLOCK = 800

_SIGNED = "doc_id long, text_key long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = 5) -> DataFrame:
    """A row for each document: set size, fingerprint, band keys, a byte a coordinate."""

    def sign(batches):
        for batch in common.slices(batches):
            sets, at = minhash.shingle_sets(*tx.utf8(batch.column("text")), shingle)
            prints = minhash.fingerprints(sets, at).view(np.int64)
            signature = minhash.circulant(sets, at, bands * rows)
            keys = minhash.band_keys(signature, rows).view(np.int64)
            size = np.diff(at)
            width = np.where(size > 0, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(size.astype(np.int64)),
                    pa.array(prints[:, 0]),
                    pa.array(prints[:, 1]),
                    common.lists(keys[size > 0].ravel(), np.concatenate([[0], np.cumsum(width)])),
                    common.blobs((signature & np.uint32(0xFF)).astype(np.uint8)),
                ],
                ["doc_id", "text_key", "n_shingles", "fp1", "fp2", "bands", "sketch"],
            )

    return common.mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), sign, _SIGNED)


def _resemblance(sketch: np.ndarray, size: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Estimated similarity of row i with rows js; -1 where sizes alone exclude a link."""
    same = (sketch[js] == sketch[i]).mean(axis=1, dtype=np.float32)
    low, high = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
    return np.where(100 * low >= PERCENT * high, (same - 1 / 256) / (1 - 1 / 256), -1)


def block_pairs(ids, size, sketch, shared, leaders, led=None) -> tuple[list, list]:
    """(leader, member) pairs to confirm, and pairs of leaders that join neighbourhoods, of one block.
    leaders: each member's leader from elsewhere, itself if it has none; members that are `led` have been
    compared with the whole bucket by theirs.  Members that share most buckets lead first, so that blocks
    of one group mostly have the same leaders and give the same pairs."""
    n, likely = len(ids), PERCENT / 100 - MARGIN
    if (leaders == leaders[0]).all():
        return [], []
    elsewhere = leaders != ids
    grouped = elsewhere | np.isin(ids, leaders[elsewhere])
    if n == 2:
        close = _resemblance(sketch, size, 0, np.array([1]))[0] >= likely
        pair = [(leaders[0], leaders[1]) if elsewhere.all() else (ids[0], ids[1])] if close else []
        return ([], pair) if elsewhere.all() else (pair, [])
    order = np.lexsort((ids, -shared))
    lead, near = [], []
    label, leader = np.full(n, -1), np.array(ids)
    _, at, group = np.unique(leaders[order], return_index=True, return_inverse=True)
    first = order[at]  # of each leader's members
    label[order] = np.where(grouped[order], first[group], -1)
    leader[first] = leaders[first]
    for i in order:
        if label[i] < 0 or label[i] == i:
            label[i] = i
            rest = np.flatnonzero(label < 0)
            if len(rest):
                got = rest[_resemblance(sketch, size, i, rest) >= likely + 0.1]
                label[got] = i
                lead += [(ids[i], ids[j]) for j in got]
    for i in range(n) if led is None else np.flatnonzero(~led):
        js = np.flatnonzero(label != label[i])
        if not len(js):
            if led is None:
                break
            continue
        met = js[_resemblance(sketch, size, i, js) >= likely]
        if len(met):
            for other in np.unique(label[met]):
                near.append((leader[label[i]], leader[other]))
                label[label == other] = label[i]
    return lead, near


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows(key, members, rest, aside, node, ...) dealt out so that a row that is not `aside`
    meets every row of its key in a cell; rest: how many such rows the key has."""
    chunk = lambda n: F.greatest(F.lit(1), F.ceil(n / block).cast("int"))
    few, many = chunk(F.col("rest")), chunk(F.col("members") - F.col("rest"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, a, b: (F.lit(kind) * 1000003 + a.cast("long")) * 1000003 + b
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    with_aside = F.transform(upto(many), lambda m: cell(1, own(few), m))
    each_other = F.transform(upto(few), lambda o: cell(2, F.least(own(few), o), F.greatest(own(few), o)))
    cells = (
        F.when(F.col("members") <= block, F.array(F.lit(0).cast("long")))
        .when(F.col("aside"), F.transform(upto(few), lambda r: cell(1, r, own(many))))
        .otherwise(F.concat(with_aside, each_other))
    )
    return rows.withColumn("cell", F.explode(cells))


def _groups(batches):
    """Tables of the rows of one key and cell, from batches sorted by them."""
    held, held_key = [], None
    for batch in batches:
        key, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            if held and (key[lo], cell[lo]) != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = (key[lo], cell[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _bucketed(keyed: DataFrame) -> DataFrame:
    """(key, node, members, shared, hub, hub_shared) of keyed(node, key) in buckets of several; shared: the sum of the
    members of a node's buckets.  The member that shares most is the hub, so that a group's buckets mostly have the same."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = common.written(keyed.join(sizes.hint("merge"), "key"))
    rows = rows.join(rows.groupBy("node").agg(F.sum("members").alias("shared")).hint("merge"), "node")
    hubs = rows.groupBy("key").agg(F.min_by("node", F.struct(-F.col("shared"), F.col("node"))).alias("hub"), F.max("shared").alias("hub_shared"))
    return rows.join(hubs.hint("merge"), "key")


def _resembling(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """rows(key, members, hub, node, shared, leader) with `aside`: whether node and hub resemble each other by their sketches."""
    names = ["key", "members", "hub", "node", "shared", "leader"]

    def run(batches):
        for batch in batches:
            get = lambda n: batch.column(n)
            own, hub = (np.frombuffer(b"".join(get(n).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for n in ("sketch", "hub_sketch"))
            x, y = get("n_shingles").to_numpy(), get("hub_n").to_numpy()
            same = ((own == hub).mean(axis=1, dtype=np.float32) - 1 / 256) / (1 - 1 / 256)
            near = (same >= PERCENT / 100 - MARGIN + 0.1) & (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([*map(get, names), pa.array(near)], [*names, "aside"])

    hubs = sketches.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    met = rows.select(*names).join(sketches.hint("merge"), "node").join(hubs.hint("merge"), "hub")
    return common.mapped(met, run, ", ".join(f"{n} long" for n in names) + ", aside boolean")


def _led(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, leader): nodes that resemble the hub that shares most of those of their buckets."""
    best = members.groupBy("node").agg(F.min_by("hub", F.struct(-F.col("hub_shared"), F.col("hub"))).alias("hub")).where("node <> hub")
    nothing = {n: F.lit(0).cast("long") for n in ("key", "members", "shared", "leader")}
    return _resembling(best.withColumns(nothing), sketches).where("aside").select("node", F.col("hub").alias("leader"))


def _pairs(members: DataFrame, sketches: DataFrame, block: int) -> DataFrame:
    """(a, b, confirm) with a < b, of members(key, hub, hub_shared, members, node, shared) and sketches(node, n_shingles, sketch)."""

    def run(batches):
        found: dict[tuple[int, int], bool] = {}

        def flush():
            p = np.array(list(found), dtype=np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(list(found.values()), pa.bool_())], ["a", "b", "confirm"])
            found.clear()
            return out

        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            ids = group.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            led = group.column("aside").to_numpy() if group.column("cell")[0].as_py() else None
            size, shared, leaders = (group.column(n).to_numpy() for n in ("n_shingles", "shared", "leader"))
            lead, near = block_pairs(ids, size, sketch, shared, leaders, led)
            for confirm, pairs in ((False, near), (True, lead)):
                for a, b in pairs:
                    if a != b:
                        key = (int(min(a, b)), int(max(a, b)))
                        found[key] = found.get(key, False) or confirm
            if len(found) > 50_000:
                yield flush()
        yield flush()

    paired = lambda rows, with_: rows.select(F.least(with_, "node").alias("a"), F.greatest(with_, "node").alias("b"), F.lit(True).alias("confirm"))
    led = common.written(_led(members, sketches))
    found = paired(led, "leader")
    members = members.join(led.hint("merge"), "node", "left").withColumn("leader", F.coalesce("leader", "node"))
    small = members.where(F.col("members") <= block).withColumns({"rest": F.col("members"), "aside": F.lit(False)})
    large = members.where(F.col("members") > block)
    if not large.isEmpty():
        seen = common.written(_resembling(large, sketches))
        found = found.union(paired(seen.where("aside and node <> hub"), "hub"))
        counted = common.written(seen.groupBy("key").agg(F.sum(F.when(F.col("aside"), 0).otherwise(1)).alias("rest")))
        seen = seen.withColumn("leader", F.when(F.col("aside"), F.col("hub")).otherwise(F.col("leader")))
        small = small.unionByName(seen.join(counted.where("rest > 0").hint("merge"), "key"), allowMissingColumns=True)
    dealt = _dealt(small, block).select("key", "cell", "node", "shared", "leader", "aside")
    # sketches are looked up once a row is dealt, and sorted with it
    dealt = dealt.join(sketches.hint("merge"), "node").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return common.mapped(dealt, run, "a long, b long, confirm boolean").union(found).groupBy("a", "b").agg(F.max("confirm").alias("confirm"))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, members): the sets of wanted(node, doc_id, fp1, fp2), from the texts."""

    def cut(batches):
        for batch in common.slices(batches):
            sets, at = minhash.shingle_sets(*tx.utf8(batch.column("text")), shingle)
            prints = minhash.fingerprints(sets, at).view(np.int64)
            own = (prints[:, 0] == batch.column("fp1").to_numpy()) & (prints[:, 1] == batch.column("fp2").to_numpy())
            out = pa.RecordBatch.from_arrays([batch.column("node"), common.lists(sets.view(np.int64), at)], ["node", "members"])
            yield out.filter(pa.array(own))  # an id may have several texts

    texts = docs.join(wanted.hint("merge"), "doc_id").select("node", "text", "fp1", "fp2")
    found = common.mapped(texts, cut, "node long, members array<long>")
    return found.groupBy("node").agg(F.first("members").alias("members"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose full sets meet the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))

    def compare(batches):
        for batch in batches:
            keep = []
            sides = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("left"), batch.column("right"))]
            for i in range(batch.num_rows):
                x, y = (v[at[i] : at[i + 1]] for v, at in sides)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= PERCENT * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return common.mapped(met.select("a", "b", "left", "right"), compare, "a long, b long")


def set_links(ids, label, values, at) -> list[tuple[int, int]]:
    """Links that join different labels, of sets values[at[i]:at[i + 1]]: all of them but
    those between labels that earlier ones have joined."""
    vocabulary, codes = np.unique(values, return_inverse=True)
    size, label = np.diff(at), label.copy()
    names, counts = np.unique(label, return_counts=True)
    rest = np.flatnonzero(label != names[counts.argmax()])
    mark = np.zeros(len(vocabulary) + 1, bool)
    links = []
    for i in rest:
        mark[codes[at[i] : at[i + 1]]] = True
        shared = np.add.reduceat(mark[codes], at[:-1], dtype=np.int64)
        mark[codes[at[i] : at[i + 1]]] = False
        met = np.flatnonzero((100 * shared >= PERCENT * (size + size[i] - shared)) & (label != label[i]))
        for j in met:
            if label[j] != label[i]:
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


def _compared(neighbours: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(a, b): links across components of neighbours(key, members, rest, aside, node, component)."""

    def run(batches):
        for group in _groups(batches):
            label = group.column("component").to_numpy()
            if (label != label[0]).any():
                sets = group.column("shingles").combine_chunks()
                at = sets.offsets.to_numpy()
                values = sets.values.to_numpy()[at[0] : at[-1]]
                links = set_links(group.column("node").to_numpy(), label, values, at - at[0])
                if links:
                    p = np.array(links, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    dealt = _dealt(neighbours, block).select("key", "cell", "node", "component")
    dealt = dealt.join(sets.select("node", F.col("members").alias("shingles")).hint("merge"), "node")
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return common.mapped(dealt, run, "a long, b long")


def _classed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key (a hash of the text) and root (a number of the
    class; null for empty sets) of each row of docs(doc_id, text)."""
    signed = common.written(signatures(docs, bands, rows, shingle))
    first = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("fp1", "fp2", "n_shingles")
        .agg(F.min_by(F.struct("bands", "sketch"), "doc_id").alias("of"), F.min("doc_id").alias("doc_id"))
    )
    first = common.written(
        first.select(F.monotonically_increasing_id().alias("node"), "doc_id", "fp1", "fp2", "n_shingles", "of.bands", "of.sketch")
    )
    sketches = first.select("node", "n_shingles", "sketch")
    shared = common.written(_bucketed(first.select("node", F.explode("bands").alias("key"))))
    likely = common.written(_pairs(shared, sketches, block))
    near = common.written(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    near = common.written(near.join(first.select(F.col("node").alias("id"), F.col("doc_id").alias("low"), "fp1", "fp2"), "id"))
    wanted = near.select(F.col("id").alias("node"), F.col("low").alias("doc_id"), "fp1", "fp2")
    sets = common.written(_sets(docs, wanted, shingle))
    links = common.written(_confirmed(likely.where("confirm").select("a", "b"), sets))
    found = common.components(near, links)

    around = common.components(near, likely.select("a", "b")).select("id", F.col("component").alias("key"))
    sizes = around.join(found, "id").groupBy("key", "component").agg(F.count("*").alias("n"))
    open_ = common.written(
        sizes.groupBy("key")
        .agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("several"))
        .where("several > 1")
        .select("key", "members", (F.col("members") - F.col("most.n")).alias("rest"), F.col("most.component").alias("most"))
    )
    neighbours = (
        around.select(F.col("id").alias("node"), "key")
        .join(open_.hint("merge"), "key")
        .join(found.select(F.col("id").alias("node"), "component"), "node")
        .withColumn("aside", F.col("component") == F.col("most"))
    )
    more = common.written(_compared(neighbours, sets, block))
    if not more.isEmpty():
        found = common.components(near, links.union(more))

    named = first.select("node", "doc_id", "fp1", "fp2", "n_shingles").join(found.withColumnRenamed("id", "node"), "node", "left")
    classes = named.select("fp1", "fp2", "n_shingles", F.coalesce("low", "doc_id").alias("class"), F.coalesce("component", "node").alias("root"))
    out = signed.select("doc_id", "text_key", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2", "n_shingles"], "left")
    whose = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", "n_shingles", whose.alias("component_id"), "text_key", "root")


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable) of each row of docs(doc_id, text)."""
    return _classed(common.named(docs, doc_id="doc_id", text="text"), **settings).drop("text_key", "root")


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each class, of its least id (of several texts with this id, that of
    the least hash); empty texts are classes of their own, of which rows that repeat an id go;
    rows with a null id all stay."""
    doc_id, text = common.column(docs, "doc_id"), common.column(docs, "text")
    found = _classed(common.named(docs, doc_id="doc_id", text="text"), **settings).where("doc_id = component_id")
    one = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select("one.*")
    kept = one.union(found.where("root is null").select("doc_id", "text_key")).distinct()
    # further columns of docs travel inside a struct, where no name can clash
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_key"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")
    )
    stay = rows.where("doc_id is not null").join(kept.hint("merge"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return stay.union(rows.where("doc_id is null")).select("row.*")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS v FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.v = y.v AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
