"""Token-id files: adaptive context mixing and a range coder, in blocks.

A file is a run of blocks.  Each block starts from an empty model and carries
checksums of its payload and of the ids it decodes to, so a damaged block is
noticed and costs no other.  A block holds whole documents; only one that is
longer than a block fills several, and those are read as one run.  Runs are
independent, so readers are dealt runs, not files.  Within a block the ids are dealt in order to lanes,
equal stretches that are coded side by side as numpy vectors; every lane has its
own range coder, and all of them teach one model.

The model mixes three orders.  Order 2 and order 1 each predict one id for their
context, with a confidence from 0 to 3; order 0 is a frequency table.  What share
of the range the two predictions and the rest get is learned for each pair of
confidences.  An id that neither predicts is coded by order 0, and one that is
new to the block as two plain 16-bit halves.  Everything is integer arithmetic.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import open_for_read, open_for_write, scratch, settle
from tessera.llm.tokens import encoder, merges_by_rank

#: Ids of a block, of a lane at least, and lanes of a block at most.
BLOCK_IDS, LANE_IDS, MOST_LANES = 1 << 20, 256, 4096
#: Steps of a lane after which the model learns; every id of every lane is taught.
LEARN_EVERY = 16
#: Ids that a reading task is to get at least, and such tasks at most; each takes its share of the runs.
READ_IDS, MOST_READERS = 4 << 20, 100_000
MAGIC = b"TIDB"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, index bytes, payload bytes, crc of payload, crc of ids
_MASK32, _LOW = 0xFFFFFFFF, 1 << 32  # the coder's numbers stay below 2^49: signed 64-bit integers hold them, and floats all of their bits
_TOTAL = 1 << 16  # of the shares of the cases, and of the frequencies of order 0; the coder's total is its square
_CONTEXTS, _HASH_SHIFT, _KNOWN_MOST, _NEW_LEAST = 1 << 18, 14, 49_152, 64
_FREQ, _WHOLE = (1 << 17) - 1, 1 << 16  # an entry of ``places`` or ``case_places``: frequency, and from bit 17 on the start; the one that is all of order 0


class _Model:
    """Predictions of order 2 and 1, frequencies of order 0, learned in batches.

    An entry of a prediction table is 4 * id + confidence.  ``places`` holds the
    frequency of each id under order 0 and, from bit 17 on, where its share
    starts; ``case_places`` the same of each case under its context.  An id's
    share of the coder's range is the product of the two; for one that is
    predicted, order 0 counts as a whole.  Whatever is used as an index is a
    64-bit integer throughout.
    """

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.order2 = np.full(_CONTEXTS, 4 * _TOTAL, np.int32)  # no id is predicted yet
        self.order1 = np.full(alphabet, 4 * _TOTAL, np.int32)
        self.counts = np.zeros(alphabet, np.int64)
        self.cases = np.tile(np.array([8, 4, 4], np.int64), (32, 1))
        self._tables()

    def _tables(self) -> None:
        share = self.cases * (_TOTAL - 3) // self.cases.sum(1, keepdims=True) + 1
        share[:, 2] += _TOTAL - share.sum(1)
        ends = np.cumsum(share, 1)
        self.case_places = (share | (ends - share) << 17).reshape(-1)
        self.end0, self.end1 = ends[:, 0] << 16, ends[:, 1] << 16
        self.rest = share[:, 2].astype(np.float64)  # what order 0's frequencies are multiplied by
        counts = self.counts
        while np.count_nonzero(counts) > _KNOWN_MOST:
            counts = counts >> 1
        known = np.flatnonzero(counts)
        freq = np.zeros(self.alphabet + 1, np.int64)  # the last: ids new to the block
        if len(known):
            freq[known] = 1 + counts[known] * (_TOTAL - _NEW_LEAST - len(known)) // counts.sum()
        freq[-1] = _TOTAL - freq.sum()
        self.places = freq | (np.cumsum(freq) - freq) << 17
        symbols = np.append(known, self.alphabet)
        self.slots = np.repeat(symbols, freq[symbols])

    def look(self, p2: np.ndarray, p1: np.ndarray):
        """(order-2 slot, its id, order 1's id, context of the case) for each lane."""
        h = ((p1 * 0x9E3779B1 + p2 * 0x85EBCA6B) & 0xFFFFFFFF) >> _HASH_SHIFT
        e2, e1 = self.order2.take(h), self.order1.take(p1)
        a, b = e2 >> 2, e1 >> 2
        context = ((e2 & 3) << 2) + (e1 & 3)
        context += np.where(a == b, np.int32(16), np.int32(0))
        return h, a, b, context.astype(np.int64)

    def share(self, k: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, frequency) of a case and, within it, of a place under order 0."""
        case = self.case_places.take(k)
        part = case & _FREQ
        return (case >> 17 << 16) + (place >> 17) * part, (place & _FREQ) * part

    @staticmethod
    def _learn(entries: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        held = entries.take(at)
        sure = held & 3
        missed = np.where(sure > 0, held - 1, ids << 2)
        entries[at] = np.where(held >> 2 == ids, held + (sure < 3), missed)

    def learn(self, batch: list[tuple]) -> None:
        h, p1, case, ids = (np.concatenate(x) for x in zip(*batch))
        short = ids.astype(np.int32)
        self._learn(self.order2, h, short)
        self._learn(self.order1, p1, short)
        self.counts += np.bincount(ids, minlength=self.alphabet)
        self.cases += np.bincount(case, minlength=96).reshape(32, 3)
        self._tables()


def _lanes(n: int) -> tuple[int, int, int]:
    lanes = max(1, min(MOST_LANES, n // LANE_IDS))
    return lanes, n // lanes, n % lanes


def _learns(step: int) -> bool:
    """Whether the model learns what it was taught since: soon at first, later every LEARN_EVERY steps."""
    return step & (step - 1) == 0 or step % LEARN_EVERY == 0


def encode_block(ids: np.ndarray) -> bytes:
    """Lane lengths and words of one block's ids (unsigned 32-bit)."""
    n = len(ids)
    lanes, base, extra = _lanes(n)
    steps, cut = base + (extra > 0), (base + 1) * extra  # the first ``extra`` lanes have an id more
    grid = np.zeros((steps, lanes), np.int64)  # a row for each step
    grid[:, :extra] = ids[:cut].reshape(extra, steps).T
    grid[:base, extra:] = ids[cut:].reshape(lanes - extra, base).T
    alphabet = int(min(ids.max(initial=0), _TOTAL - 1)) + 1
    model = _Model(alphabet)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    out, spot = np.zeros((4 * steps + 2) * lanes, np.uint32), np.arange(lanes)  # a row of words for all lanes; each lane's next place
    p1, p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def shift(lane, lo, width):
        """Put out words of those lanes whose ranges are short, until none is."""
        short = np.flatnonzero(width < _LOW)
        while len(short):
            at, part = short if lane is None else lane[short], lo[short]
            out[spot[at]] = part >> 32
            spot[at] += lanes
            lo[short] = (part & _MASK32) << 16
            width[short] <<= 16
            short = short[width[short] < _LOW]

    def code_all(m, start, freq):
        r = rng[:m] >> 32
        start *= r
        freq *= r
        lo = low[:m] + start
        short = freq < _LOW
        out[spot[:m]] = lo >> 32  # where no word is due the place stays, and is written again
        due = short.astype(np.int64)
        spot[:m] += due * lanes
        lo &= (due - 1) | _MASK32
        due <<= 4
        lo <<= due
        freq <<= due
        shift(None, lo, freq)
        low[:m], rng[:m] = lo, freq

    def code_some(who, start, freq):
        r = rng[who] >> 32
        lo, width = low[who] + r * start, r * freq
        shift(who, lo, width)
        low[who], rng[who] = lo, width

    batch = []
    for step in range(steps):
        m = lanes if step < base else extra
        x, q1 = grid[step, :m], p1[:m]
        h, a, b, context = model.look(p2[:m], q1)
        missed = x != a
        other = missed & (x != b)
        k = context * 3 + missed + other
        symbol = np.minimum(x, alphabet)
        place = model.places.take(symbol)
        unknown = np.flatnonzero((place & _FREQ) == 0)
        if len(unknown):
            symbol[unknown] = alphabet
            place[unknown] = model.places[alphabet]
        code_all(m, *model.share(k, np.where(other, place, _WHOLE)))
        new = np.flatnonzero(other & (symbol == alphabet))
        if len(new):
            code_some(new, (x[new] >> 16) << 16, _TOTAL)
            code_some(new, (x[new] & 0xFFFF) << 16, _TOTAL)
        kept = np.minimum(x, alphabet - 1)
        batch.append((h, q1, k, kept))
        p2, p1 = q1, kept
        if _learns(step + 1):
            model.learn(batch)
            batch = []
    out[spot] = (low + _MASK32) >> 32
    pos = spot // lanes + 1
    out = out.reshape(-1, lanes)
    for row in range(int(pos.max()) - 1, 0, -1):  # carries
        out[row - 1] += out[row] >> 16
    out = np.ascontiguousarray((out[: pos.max()] & 0xFFFF).astype("<u2").T)
    words = out[np.arange(out.shape[1]) < pos[:, None]]
    return struct.pack("<I", alphabet) + pos.astype("<u4").tobytes() + words.tobytes()


def decode_block(data: bytes, n: int) -> np.ndarray:
    lanes, base, extra = _lanes(n)
    (alphabet,) = struct.unpack_from("<I", data)
    sizes = np.frombuffer(data, "<u4", lanes, 4).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    ptr = starts + 3 * np.arange(lanes)  # three words of 0 follow each lane's
    words = np.zeros(int(ends[-1]) + 3 * lanes, np.int64)
    words[np.repeat(ptr - starts, sizes) + np.arange(ends[-1])] = np.frombuffer(data, "<u2", -1, 4 + 4 * lanes)
    model = _Model(alphabet)
    rng, code = np.full(lanes, 1 << 48, np.int64), np.zeros(lanes, np.int64)
    for _ in range(3):
        code = (code << 16) | words[ptr]
        ptr += 1

    def value(code, rng):
        r = rng >> 32
        return r, np.minimum((code / r).astype(np.int64), _MASK32)  # exact: quotients below 2^32 of divisors up to 2^16

    def fill(lane, left, width):
        """Take in words for those lanes whose ranges are short, until none is."""
        short = np.flatnonzero(width < _LOW)
        while len(short):
            at = short if lane is None else lane[short]
            left[short] = (left[short] << 16) | words[ptr[at]]
            ptr[at] += 1
            width[short] <<= 16
            short = short[width[short] < _LOW]

    def take_all(m, r, start, freq):
        start *= r
        freq *= r
        left, short = code[:m] - start, freq < _LOW
        due = short.astype(np.int64)
        more = words.take(ptr[:m]) & -due
        ptr[:m] += due
        due <<= 4
        left <<= due
        left |= more
        freq <<= due
        fill(None, left, freq)
        code[:m], rng[:m] = left, freq

    def take_some(who, r, start, freq):
        left, width = code[who] - r * start, r * freq
        fill(who, left, width)
        code[who], rng[who] = left, width

    steps = base + (extra > 0)
    grid = np.zeros((steps, lanes), np.int64)
    p1, p2, batch = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), []
    for step in range(steps):
        m = lanes if step < base else extra
        q1 = p1[:m]
        h, a, b, context = model.look(p2[:m], q1)
        r, v = value(code[:m], rng[:m])
        end1 = model.end1.take(context)
        left = v - end1
        other, first = left >= 0, v < model.end0.take(context)
        k = context * 3 + ~first + other
        slot = (np.maximum(left, 0) / model.rest.take(context)).astype(np.int64)
        symbol = model.slots.take(np.minimum(slot, _TOTAL - 1))
        place = model.places.take(symbol)
        take_all(m, r, *model.share(k, np.where(other, place, _WHOLE)))
        x = np.where(other, symbol, np.where(first, a, b))
        new = np.flatnonzero(other & (symbol == alphabet))
        if len(new):
            halves = []
            for _ in range(2):
                r, half = value(code[new], rng[new])
                half >>= 16
                take_some(new, r, half << 16, _TOTAL)
                halves.append(half)
            x[new] = (halves[0] << 16) | halves[1]
        grid[step, :m] = x
        kept = np.minimum(x, alphabet - 1)
        batch.append((h, q1, k, kept))
        p2, p1 = q1, kept
        if _learns(step + 1):
            model.learn(batch)
            batch = []
    return np.concatenate([grid[:, :extra].T.reshape(-1), grid[:base, extra:].T.reshape(-1)]).astype("<u4")


def write_block(out, index: list[tuple[int | None, int, bool]], ids: bytes) -> int:
    """Append a block; ``index`` has (doc_id, ids, whether more follow in the next block)."""
    table = zlib.compress(
        b"".join(struct.pack("<qIB", doc or 0, n, more | (doc is None) << 1) for doc, n, more in index), 6
    )
    data = np.frombuffer(ids, "<u4")
    payload = encode_block(data)
    out.write(_HEAD.pack(MAGIC, len(data), len(index), len(table), len(payload), zlib.crc32(table + payload), zlib.crc32(ids)))
    out.write(table)
    out.write(payload)
    return _HEAD.size + len(table) + len(payload)


def read_blocks(source, end: int | None = None):
    """(index, ids) of each block from where an open file stands, up to ``end``; a block that fails its checksums raises."""
    while (end is None or source.tell() < end) and (head := source.read(_HEAD.size)):
        magic, n, docs, table_size, size, stored, ids_crc = _HEAD.unpack(head)
        body = source.read(table_size + size)
        if magic != MAGIC or zlib.crc32(body) != stored:
            raise ValueError("damaged block")
        table = zlib.decompress(body[:table_size])
        index = [(None if flags & 2 else doc, k, bool(flags & 1)) for doc, k, flags in struct.iter_unpack("<qIB", table)]
        ids = decode_block(body[table_size:], n)
        if len(index) != docs or zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError("a block doesn't decode to what was written")
        yield index, ids


_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])


class _FileWriter:
    """Blocks of one file and a manifest row for each run of them that can be read on its own."""

    def __init__(self, path: str, part: int):
        self.out, self.path, self.part = open_for_write(path), path, part
        self.index, self.held, self.runs = [], bytearray(), []
        self.at = self.ids = self.run_at = self.run_ids = self.docs = 0

    def add(self, doc_id, ids: bytes) -> None:
        room = 4 * BLOCK_IDS
        if self.held and len(self.held) + len(ids) > room:
            self.end_run()
        self.docs += 1
        for at in range(0, len(ids), room):
            piece = ids[at : at + room]
            self.index.append((doc_id, len(piece) // 4, at + room < len(ids)))
            self.held += piece
            if at + room < len(ids):
                self._flush()

    def _flush(self) -> None:
        self.at += write_block(self.out, self.index, bytes(self.held))
        self.ids += len(self.held) // 4
        self.index, self.held = [], bytearray()

    def end_run(self) -> None:
        self._flush()
        self.runs.append((self.part, self.path, self.run_at, self.at - self.run_at, self.run_ids, self.ids - self.run_ids, self.docs))
        self.run_at, self.run_ids, self.docs = self.at, self.ids, 0

    def close(self) -> pa.RecordBatch:
        self.end_run()
        self.out.close()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.runs), _MANIFEST)], schema=_MANIFEST)


def write_token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending doc_id order.

    Returns one row per run of blocks: part, path, offset and n_bytes of the run,
    first (ids of the file before it), n_ids, n_docs; parts follow the order of
    doc_ids.  Names are new for each attempt of a task and only those returned
    count, so repeated or lost tasks do no harm.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    by_rank = merges_by_rank(tokenizer_path)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        enc, context, end = encoder(tokenizer_path, by_rank=by_rank), TaskContext.get(), end_id.to_bytes(4, "little")
        part, out = context.partitionId(), None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = out or _FileWriter(f"{folder}/part-{part:06d}-{context.taskAttemptId()}.tid", part)
                out.add(doc_id, enc.ids(text or "") + end)
        if out:
            yield out.close()

    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text")]
    ordered = docs.select(*keys).repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    written = ordered.select("doc_id", "text").mapInArrow(write, "part int, path string, offset long, n_bytes long, first long, n_ids long, n_docs long")
    return settle(written, "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files' blocks.

    What comes to the driver is a row per file, for the number of ids before it.
    """
    spark = manifest.sparkSession
    rows, base = [], 0
    for part, n in sorted(tuple(r) for r in manifest.groupBy("part").agg(F.sum("n_ids")).collect()):
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part int, base long")
    runs = manifest.join(F.broadcast(bases), "part").select("path", "offset", "n_bytes", (F.col("base") + F.col("first")).alias("at"))
    tasks = max(1, min(-(-base // READ_IDS), MOST_READERS))

    def read(frames):
        for pdf in frames:
            for path, offset, size, at in zip(pdf["path"], pdf["offset"], pdf["n_bytes"], pdf["at"]):
                with open_for_read(path) as source:
                    source.seek(int(offset))
                    start, crc, end = at, 0, int(offset + size)
                    for index, ids in read_blocks(source, end):
                        raw, i, done = memoryview(ids.tobytes()), 0, []
                        for doc_id, n, more in index:
                            crc = zlib.crc32(raw[4 * i : 4 * (i + n)], crc)
                            i, at = i + n, at + n
                            if not more:
                                done.append((doc_id, start, at - start, crc))
                                start, crc = at, 0
                        out = pd.DataFrame(done, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        yield out.astype({"doc_id": "Int64"})

    return runs.repartition(tasks, "path", "offset").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def roundtrip(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2) -> DataFrame:
    """Write token files for ``docs`` and read them back.

    A null text counts as the empty one, which is the end id alone.  Null
    doc_ids come first; rows of one doc_id follow each other in an order that
    depends on their texts alone.  An empty table gives an empty one.
    """
    return read_token_files(write_token_files(docs, tokenizer_path, end_id=end_id))
