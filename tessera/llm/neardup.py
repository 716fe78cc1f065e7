"""Near-duplicate classes: ProbMinHash, banding, exact verification.

Texts are sets of shingles of five lower-cased white-space words.  Each shingle
is an exponential arrival process whose rate is its weight; every arrival lands
on one register of the signature, and a register keeps the shingle that arrived
first.  Once a process is past the last register's time it can change nothing, so
it ends early.  Two signatures agree on a register with the probability Jaccard
of the weighted sets.  Every distinct shingle weighs 1, however often it is
repeated, so that this is the very Jaccard that is verified.  Groups of five
registers are hashed to bands; texts that share a band are candidates, and all
candidates of a bucket are compared by the exact Jaccard of their shingle sets.

Exact copies stand as one node throughout.  A bucket larger than one block is
first compared in blocks, dealt differently in each band, so that a large group
of near copies grows together at linear cost; then whatever isn't in the bucket's
largest class is compared with all of the bucket, block by block.  So no
candidate pair of different classes is left out, at whatever size of bucket, and
no task holds more than two blocks, which are bounded by texts and by bytes.
Links leave a task as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import digest_of, settle, slices, spread_join, whole_number

#: Words of a shingle and the similarity that makes two texts near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and registers of each; 0.8 alike texts share one with probability 0.99995.
BANDS, ROWS = 25, 5
#: Texts of a bucket that are compared at once, and about the bytes of their shingle sets at most.
BLOCK, BLOCK_BYTES = 256, 16 << 20
_COLUMNS_AT_ONCE = 8192
_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every shingle of every text, in order.

    A text of fewer than SHINGLE words is one shingle; one without words has none.
    """
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten().dictionary_encode()
    offsets -= offsets[0]
    known = pd.util.hash_array(np.array(flat.dictionary.to_pylist(), dtype=object), categorize=False) if len(flat) else np.zeros(0, np.uint64)
    hashed = known[flat.indices.to_numpy()] if len(flat) else known
    sizes = np.diff(offsets)
    blank = np.asarray(pc.equal(pc.binary_length(pc.utf8_trim_whitespace(pc.fill_null(texts, ""))), 0))
    n = np.where(blank, 0, np.maximum(sizes - SHINGLE + 1, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(len(row))
    end = offsets[1:][row]
    out = np.zeros(len(row), np.uint64)
    padded = np.append(hashed, np.zeros(SHINGLE, np.uint64))
    for i in range(SHINGLE):
        out = out * _G + np.where(first + i < end, padded[np.minimum(first + i, len(padded) - 1)], np.uint64(i + 1))
    return row, _mix(out)


def prob_minhash(row: np.ndarray, items: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Signatures (n_rows x registers) of weighted sets; rows without items stay 0."""
    best = np.full(n_rows * registers, np.inf)
    sig = np.zeros(n_rows * registers, np.uint64)
    seed, rate, arrival = items.copy(), weights.astype(float), np.zeros(len(items))
    while len(items):
        seed = seed + _G
        draw = _mix(seed)
        arrival = arrival - np.log(((draw >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / rate
        live = arrival <= best.reshape(n_rows, registers).max(axis=1)[row]
        row, items, seed, rate, arrival = row[live], items[live], seed[live], rate[live], arrival[live]
        at = row * registers + (_mix(draw[live] ^ _G) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, at, arrival)
        won = best[at] == arrival
        sig[at[won]] = items[won]
    return sig.reshape(n_rows, registers)


def band_hashes(texts: pa.Array, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit band hashes (texts x bands), and the number of each text's distinct shingles."""
    row, items = shingles(texts)
    key = _mix(items + row.astype(np.uint64) * _G)  # tells equal shingles of different texts apart
    _, at = np.unique(key, return_index=True)
    sig = prob_minhash(row[at], items[at], np.ones(len(at)), len(texts), bands * rows).reshape(len(texts), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _G, (len(texts), bands)).copy()
    for i in range(rows):
        out = _mix(out + sig[:, :, i])
    return out.view(np.int64), np.bincount(row[at], minlength=len(texts))


def shingle_sets(texts: pa.Array) -> list[bytes]:
    """Sorted distinct 32-bit shingle hashes of each text, as bytes."""
    row, items = shingles(texts)
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    low = (items >> np.uint64(32)).astype("<u4")
    return [np.unique(low[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]


def jaccard_links(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets at least ``similar`` alike, as (set, root)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # others are in no intersection
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(n), sizes)
    keep = shared[at]
    owner, at = owner[keep], column[at[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(shared.sum()), _COLUMNS_AT_ONCE):
        a, b = np.searchsorted(at, [lo, lo + _COLUMNS_AT_ONCE])
        x = np.zeros((n, min(_COLUMNS_AT_ONCE, int(shared.sum()) - lo)), np.float32)
        x[owner[a:b], at[a:b] - lo] = 1
        both += x @ x.T
    union = sizes[:, None] + sizes[None, :] - both
    near = np.triu(both >= similar * union - 1e-6, 1)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def _by_group(keys: int, work: Callable[[list, list], list[tuple]]):
    """mapInArrow function: ``work(nodes, items)`` for each run of equal first ``keys`` columns."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        now, nodes, items, out = None, [], [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, node, item in zip(*columns):
                if key != now:
                    out += work(nodes, items)
                    now, nodes, items = key, [], []
                nodes.append(node)
                items.append(item)
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*out)], schema=schema)
                out = []
        out += work(nodes, items)
        if out:
            yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*out)], schema=schema)

    return run


def _links_of(grouped: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """Links among the rows (keys, node, items) of each group of at most two blocks."""

    def work(nodes: list, items: list) -> list[tuple]:
        if len(nodes) < 2:
            return []
        found = {n: np.frombuffer(x, "<u4") for n, x in sorted(zip(nodes, items))}
        names = list(found)
        return [(names[i], names[j]) for i, j in jaccard_links(list(found.values()), similar)]

    n = max(int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = grouped.select(*keys, "node", "items").repartition(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_by_group(len(keys), work), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the least node it is connected to.

    Each round maps every node to the least of itself and its neighbours and
    contracts the links by that map; every link loses an end in each, and the
    rounds are written out, so lineage stays short.  A node with many links is
    spread over tasks.
    """
    edges = settle(links.where("a != b").distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("n")).select("node", F.least("node", "least").alias("up"), "n")
        step = settle(step, "up")
        if found is None:
            found = step.select("node", F.col("up").alias("root"))
        else:
            counts = found.groupBy("root").agg(F.count("*").alias("n"))
            roots = settle(counts.join(step.select(F.col("node").alias("root"), "up"), "root", "left"), "moves")
            found = settle(spread_join(found, roots, "root", "node").select("node", F.coalesce("up", "root").alias("root")), "roots")
        up_a, up_b = step.select(F.col("node").alias("a"), F.col("up").alias("up_a"), "n"), step.select(F.col("node").alias("b"), F.col("up").alias("up_b"), "n")
        moved = spread_join(spread_join(edges, up_a, "a", "b"), up_b, "b", "a").where("up_a != up_b")
        edges = settle(moved.select(F.greatest("up_a", "up_b").alias("a"), F.least("up_a", "up_b").alias("b")).distinct(), "edges")
    return found if found is not None else links.sparkSession.createDataFrame([], "node binary, root binary")


def candidate_buckets(keyed: DataFrame) -> DataFrame:
    """(bucket, node, n, n_bytes) of the buckets that hold at least two nodes, from distinct (bucket, node, items).

    n_bytes is that of the bucket's shingle sets, of ``items`` shingles each.  Of
    buckets with the same nodes one is kept.
    """
    counted = (
        keyed.groupBy("bucket")
        .agg(F.count("*").alias("n"), (4 * F.sum("items")).alias("n_bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .where("n > 1")
        .groupBy("n", "n_bytes", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
    )
    counted = settle(counted.select("bucket", "n", F.col("n").alias("size"), "n_bytes"), "buckets")
    return spread_join(keyed.select("bucket", "node"), counted, "bucket", "node").select("bucket", "node", F.col("size").alias("n"), "n_bytes")


def linked_classes(members: DataFrame, sets: DataFrame, *, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(node, root) of the classes that candidate buckets hold.

    ``members``: bucket, node, n (nodes of the bucket), n_bytes (of their sets).
    ``sets``: node, items (sorted distinct 32-bit hashes as bytes).  Nodes without
    a partner are left out.
    """

    def parts(n, n_bytes):
        return F.greatest(F.ceil(n / F.lit(block)), F.ceil(n_bytes / F.lit(BLOCK_BYTES)))

    blocks = parts(F.col("n"), F.col("n_bytes"))
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks))
    links = settle(_links_of(dealt.join(sets, "node"), ["bucket", "block"], similar), "links")
    large = members.where(blocks > 1)
    if large.isEmpty():
        return components(links)
    roots = components(links)
    large = settle(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "large")
    per_class = large.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.first("n_bytes").alias("n_bytes"))
    main = per_class.groupBy("bucket").agg(F.max_by("root", "k").alias("main"), F.sum("k").alias("n"), F.max("k").alias("k"), F.first("n_bytes").alias("n_bytes")).where("n > k")
    main = settle(main.select("bucket", "main", "n", parts(F.col("n") - F.col("k"), F.col("n_bytes")).alias("u"), parts(F.col("n"), F.col("n_bytes")).alias("v")), "main")
    split = spread_join(large.select("bucket", "node", "root"), main, "bucket", "node")
    mine_u, mine_v = F.pmod(F.xxhash64("node", F.lit(1)), "u"), F.pmod(F.xxhash64("node", F.lit(2)), "v")

    def turns(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    others = split.where("root != main").select("bucket", "node", mine_u.alias("i"), turns("v").alias("j"))
    every = split.select("bucket", "node", turns("u").alias("i"), mine_v.alias("j"))
    across = others.unionByName(every).distinct().join(sets, "node")
    more = _links_of(across, ["bucket", "i", "j"], similar)
    return components(links.unionByName(settle(more, "more-links")))


def near_classes(docs: DataFrame, *, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, heads): rows has doc_id and digest of every row of ``docs``;
    texts has node (the digest), root (its class) and copies of every distinct
    text; heads has one row per class: root, class_id, class_size, n (distinct
    texts) and kept_digest, the text of the row with class_id.

    A null text counts as the empty one; texts without words are one class only
    if they are equal.  class_id is the least doc_id of the class, null only
    where all of its rows have none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("items", pa.int64())])

    def sign(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            texts = batch.column(2)
            found, n = band_hashes(texts, bands, rows)
            lists = pa.array([x if k else None for k, x in zip(n, found)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), lists, pa.array(n, pa.int64())], schema=schema)

    keyed = docs.select(whole_number(F.col("doc_id")).alias("doc_id"), digest_of(F.col("text")).alias("digest"), "text")
    signed = settle(keyed.mapInArrow(sign, "doc_id long, digest binary, bands array<long>, items long"), "signatures")
    nodes = signed.groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("items").alias("items"))
    nodes = settle(nodes, "nodes")
    members = settle(candidate_buckets(nodes.select(F.explode("bands").alias("bucket"), "node", "items")), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node").select(F.col("node").alias("digest"), F.col("doc_id").alias("wanted_id"))
    chosen = keyed.join(wanted, (keyed["digest"] == wanted["digest"]) & keyed["doc_id"].eqNullSafe(wanted["wanted_id"]), "left_semi")

    def collect_sets(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.record_batch({"node": batch.column(0), "items": pa.array(shingle_sets(batch.column(1)), pa.binary())})

    sets = chosen.select("digest", "text").mapInArrow(collect_sets, "node binary, items binary").dropDuplicates(["node"])
    roots = linked_classes(members, settle(sets, "shingle-sets"), similar=similar)
    named = nodes.select("node", "doc_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = settle(named, "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("kept"), F.col("node").alias("kept_digest"))).alias("first")
    heads = named.groupBy("root").agg(first, F.sum("copies").alias("class_size"), F.count("*").alias("n"))
    heads = heads.select("root", F.col("first.kept").alias("class_id"), "class_size", F.col("first.kept_digest").alias("kept_digest"), "n")
    return signed.select("doc_id", "digest"), named.select("node", "root", "copies"), settle(heads, "heads")


def near_duplicates(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size for every row of ``docs``.

    class_id is the least doc_id of the row's class; a row without near or exact
    copies is a class of its own.  Repeated rows are copies of each other.  An
    empty table gives an empty one; other columns are ignored.
    """
    rows, texts, heads = near_classes(docs, similar=similar)
    facts = spread_join(texts, heads.drop("kept_digest"), "root", "node").select(F.col("node").alias("digest"), "class_id", "class_size", F.col("copies").alias("n"))
    return spread_join(rows, settle(facts, "classes"), "digest", "doc_id").select("doc_id", "class_id", "class_size")


def deduplicated(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stand for their classes: one of each, columns unchanged.

    That is the row with the least doc_id; of several rows with this id and text
    any one, where they differ in other columns.  Null and empty texts are copies
    of each other.  An empty table gives an empty one.
    """
    _, _, heads = near_classes(docs, similar=similar)
    kept = heads.select(F.col("kept_digest").alias("key"), F.col("class_id").alias("kept_id"))
    full = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), whole_number(F.col("doc_id")).alias("row_id"), digest_of(F.col("text")).alias("key"))
    # both columns are keys of the join, so a large group of copies isn't dealt to one task
    chosen = full.join(kept, (full["key"] == kept["key"]) & full["row_id"].eqNullSafe(kept["kept_id"])).select("row", full["key"]).dropDuplicates(["key"])
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
