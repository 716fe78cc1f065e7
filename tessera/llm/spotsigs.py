"""Document fingerprints: SpotSigs.

A signature is a chain: a common word (the anchor) and the CHAIN content words
that follow it, common words skipped.  Common words fall where natural prose is,
so markup and boilerplate leave few signatures.  A document's fingerprint is its
set of signature hashes; two fingerprints compare by Jaccard, and comparing ends
early where the set lengths alone, or what is left of the two sorted sets, rule
the wanted likeness out.

``is_near`` tells whether two fingerprints are near: by their set-length partitions
first, then by a Jaccard that stops once what is left can't decide for near any
more.  ``near_classes`` compares a whole corpus: documents are dealt to partitions of set
length, each wide enough that a partner is in the same or the next one, and meet
through an inverted index over the rarest signatures of each (a prefix that no
pair of the wanted likeness can avoid sharing).

A text without signatures falls back to the hashes of its words in fives, and
one of fewer words to the hash of the whole text, so equal texts always have
equal fingerprints and an empty text has the empty one.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import neardup
from tessera.llm.shared import settle, spread_join

#: Content words of a chain.
CHAIN = 2
#: Likeness that counts as near, and hashes of each set that a comparison merges at once.
NEAR, _STEP = 0.8, 64
# Frequent function words of English, German, French and Spanish.
ANCHORS = frozenset(
    """the of and to in a is that it for was on are as with be by at this from or an have not but had his they which you were
    der die das und ist von zu mit auf für im den des ein eine nicht sich dem es als auch an werden aus er hat dass sie nach wird bei
    le la les de des du un une et est que qui dans pour par sur en au pas il elle sont avec ce plus ne se ou aux
    el los las y del que en un una es por con para no su al lo como más o pero sus se""".split()
)


def signature_hashes(text: str) -> np.ndarray:
    """Sorted distinct unsigned 32-bit hashes of the text's signatures."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    content = [i for i, w in enumerate(words) if w not in ANCHORS]
    chains, k, n = set(), 0, len(content)
    for i, w in enumerate(words):
        if k < n and content[k] == i:
            k += 1
        elif k + CHAIN <= n:
            chains.add(w + " " + " ".join([words[j] for j in content[k : k + CHAIN]]))
        else:
            break
    if not chains:
        chains = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(x) for x in chains], np.uint32))


def length_band(n: int, near: float = NEAR) -> int:
    """Partition of a set length: [1, 1/near), [1/near, 1/near^2), ...; sets at least ``near`` alike are at most one apart."""
    return int(math.floor(math.log(n) / -math.log(near) + 1e-9)) if n else -1


def is_near(a: np.ndarray, b: np.ndarray, near: float = NEAR) -> bool:
    """Whether the Jaccard of two sorted sets is at least ``near``, looked at no longer than needed.

    Pairs whose set-length partitions are more than one apart, or whose lengths
    bound the Jaccard below ``near``, aren't compared; others are merged block by
    block until the rest can't make up what is missing.  Two empty sets are near.
    """
    if not len(a) or not len(b):
        return len(a) == len(b)
    if abs(length_band(len(a), near) - length_band(len(b), near)) > 1 or min(len(a), len(b)) < near * max(len(a), len(b)) - 1e-9:
        return False
    needed = math.ceil(near / (1 + near) * (len(a) + len(b)) - 1e-9)
    both = i = j = 0
    while i < len(a) and j < len(b):
        if both + min(len(a) - i, len(b) - j) < needed:
            return False
        last = min(a[min(i + _STEP, len(a)) - 1], b[min(j + _STEP, len(b)) - 1])
        k, m = i + int(np.searchsorted(a[i : i + _STEP], last, side="right")), j + int(np.searchsorted(b[j : j + _STEP], last, side="right"))
        both += len(np.intersect1d(a[i:k], b[j:m], assume_unique=True))
        i, j = k, m
    return both >= needed


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets; two empty ones are equal (1)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def to_string(hashes: np.ndarray) -> str:
    """The set length and the whole sorted set, base64 of little-endian 32-bit hashes."""
    return f"{len(hashes)}:{base64.b64encode(hashes.astype('<u4').tobytes()).decode()}"


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), "<u4")


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """id, n_signatures, hashes (sorted longs) of every row; null and empty texts have none."""

    def run(batches):
        for batch in batches:
            sets = [signature_hashes(t or "") for t in batch.column(1).to_pylist()]
            lists = pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch({"id": batch.column(0), "n_signatures": pa.array([len(s) for s in sets], pa.int32()), "hashes": lists})

    return docs.select(F.col(id_column).cast("long").alias("id"), "text").mapInArrow(run, "id long, n_signatures int, hashes array<long>")


def length_partition(n, near: float):
    """Partition of a set length: [1, 1/near), [1/near, 1/near^2), ... so partners are at most one apart."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(near)) + F.lit(1e-9)).cast("int")


def near_classes(docs: DataFrame, *, near: float = NEAR, id_column: str = "doc_id") -> DataFrame:
    """id and class_id (the least id of the class) of every row of ``docs``.

    Rows are in one class where a chain of fingerprints at least ``near`` alike
    connects them.  Null and empty texts have the empty fingerprint and are one
    class; rows without an id have a class like any other, named by the least id.

    Fingerprints become candidates of each other by a rare signature: any pair
    at least ``near`` alike shares one among the first n - ceil(near * n) + 1 of
    both, rarest first.  Buckets are (set-length partition, signature), and
    fingerprints join those of their own partition and the one below, so that
    buckets hold no pair that set lengths rule out by more than a partition.
    """
    sets = fingerprints(docs, id_column=id_column).withColumn("node", F.unhex(F.md5(F.to_json("hashes").cast("binary"))))
    rows = settle(sets, "spotsigs")
    nodes = rows.where("n_signatures > 0").groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("n_signatures").alias("n"))
    nodes = settle(nodes, "spotsigs-nodes")
    exploded = nodes.select("node", "n", F.explode("hashes").alias("h"))
    order = exploded.groupBy("h").agg(F.count("*").alias("df"))
    ranked = exploded.join(order, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("ordered"))
    prefix = F.slice("ordered", F.lit(1), (F.col("n") - F.ceil(F.col("n") * near - 1e-9) + 1).cast("int"))
    keys = ranked.select("node", "n", length_partition(F.col("n"), near).alias("part"), F.explode(prefix).alias("s"))
    keyed = keys.select("node", "n", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("s.h").alias("h"))
    keyed = keyed.select(F.xxhash64("part", "h").alias("bucket"), "node", F.col("n").alias("items")).distinct()
    members = settle(neardup.candidate_buckets(keyed), "spotsigs-members")
    roots = neardup.linked_classes(members, nodes.select("node", "hashes").mapInArrow(_pack, "node binary, items binary"), similar=near)
    counted = rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = settle(counted, "spotsigs-counted")
    heads = settle(counted.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "spotsigs-heads")
    classes = settle(spread_join(counted.select("root", "node", F.col("n").alias("copies")), heads, "root", "node"), "spotsigs-classes")
    return spread_join(rows.select("id", "node"), classes.select("node", "class_id", F.col("copies").alias("n")), "node", "id").select("id", "class_id")


def _pack(batches):
    for batch in batches:
        items = [np.array(x, np.int64).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.record_batch({"node": batch.column(0), "items": pa.array(items, pa.binary())})


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_is_near", pa.bool_()), ("next_is_near", pa.bool_())]
)
_OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_is_near boolean, next_is_near boolean"


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = own if edited == text else signature_hashes(edited)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        to_string(own),
        to_string(changed),
        likeness(own, changed),
        likeness(own, other),
        is_near(own, changed),
        is_near(own, other),
    )


def compare_with_next(docs: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Each document against its edited text and the next document by descending doc_id.

    near_edited and near_next are exact likenesses; edited_is_near and
    next_is_near are what the pruned comparison at NEAR says.  After the last
    document comes the first; a single document follows itself.  Null texts count
    as empty and null doc_ids come last; rows of one doc_id are ordered by a hash
    of their texts, descending.  An empty table gives an empty one.

    Documents are dealt once, to parts cut at quantiles of their order, so that
    neighbours stream by within a task.  The first document of each part goes to
    the part before it as well; that is one text per part.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    low = rows.agg(F.min("doc_id")).first()[0] or 0
    fraction = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(2**63))), 11) * F.lit(2.0**-53)  # of the tie's order
    rows = rows.withColumn("key", -(F.coalesce(F.col("doc_id").cast("double"), F.lit(float(low) - 2.0)) + fraction))
    found = rows.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)
    cuts = [-math.inf, *sorted(set(found)), math.inf]
    if found:
        placed = Bucketizer(splits=cuts, inputCol="key", outputCol="bucket").transform(rows).withColumn("part", F.col("bucket").cast("int"))
    else:
        placed = rows.withColumn("part", F.lit(0))
    heads = placed.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("h")).select("part", "h.doc_id", "h.tie")
    heads = sorted((tuple(r) for r in heads.collect()), key=lambda r: r[0])  # a row per part
    before = [(heads[i - 1][0], doc_id, tie) for i, (_, doc_id, tie) in enumerate(heads)]
    wanted = F.broadcast(spark.createDataFrame(before, "to_part int, head_id long, head_tie long"))
    first = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("head_id")) & (rows["tie"] == F.col("head_tie")))
    first = first.select("to_part", "doc_id", "tie", "text").dropDuplicates(["to_part"])
    dealt = placed.select("part", F.lit(False).alias("is_next"), "doc_id", "tie", "text").unionByName(first.select(F.col("to_part").alias("part"), F.lit(True).alias("is_next"), "doc_id", "tie", "text"))
    dealt = dealt.repartitionById(max(1, len(cuts) - 1), "part").sortWithinPartitions("part", "is_next", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())

    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            out = []
            for is_next, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = signature_hashes(text)
                if held:
                    out.append(_compared(*held, text, own))
                held = None if is_next else (doc_id, text, own)
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return dealt.select("is_next", "doc_id", "text").mapInArrow(run, _OUT_DDL)
