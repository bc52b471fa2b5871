"""SimHash near-dedup with Golay-code keys.

Fingerprints of 64 bits are cut into segments of 22, 21 and 21 bits, read as words of the perfect
binary Golay code of length 23, which decodes any word to the one codeword within 3 bits. A word
and one that differs in a single bit share a codeword among those that the words within one bit
decode to: one key in every 7 words, six keys in the others.

Of at most 3 differing bits, pigeonhole leaves two cases:
- all three segments differ in at most one bit. Then segments 1 and 2 share codewords, and one
  half of segment 3 is equal.
- some segment is equal and some other differs in at most one bit.
So links share one of a fingerprint's keys: 108 at most, about 90 on average. Fingerprints that share a key are
compared bit by bit.
"""

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.llm.common import numbered, row_key, stored, table
from stintlake.llm.graph import components

SHINGLE = 3
MOST_BITS = 3
SEED = 42
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Halves of the third segment.
HALVES = ((43, 11), (54, 10))
#: More fingerprints than this under one key are compared in blocks of so many.
BLOCK = 1000
#: Shingles whose bits are unpacked at a time.
SLICE = 50_000
#: Texts of a batch that are Python strings at a time.
ROWS = 200

# Fixed value: a generator polynomial of the binary Golay code,
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
CHECK_BITS, CODE_BITS = 11, 23


# --- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six white space bytes
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -SHINGLE] + 1])
    digest = xxhash.xxh64_intdigest
    return [
        digest(joined[s:e], SEED)
        for s, e in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    ]


def fingerprints(texts: list[str]) -> np.ndarray:
    """Bit by bit, whether over half the shingle hashes have it; zero for no words."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text or "")
        if not hashes:
            continue
        codes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(codes), SLICE):
            part = np.unpackbits(codes[at : at + SLICE], axis=1, bitorder="little")
            ones += part.sum(0, dtype=np.uint32)
        out[i] = weights[2 * ones > len(codes)].sum(dtype=np.uint64)
    return out


def _with_fingerprint(batches):
    for batch in batches:
        texts = batch.column("text")
        found = np.zeros(batch.num_rows, np.uint64)
        for i in range(0, batch.num_rows, ROWS):  # a few texts at a time as Python strings
            found[i : i + ROWS] = fingerprints(texts.slice(i, ROWS).to_pylist())
        found = found.view(np.int64)
        at = batch.schema.get_field_index("text")
        names = [n for n in batch.schema.names if n != "text"]
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*names, "fp"])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Puts `fp`, the fingerprint as a signed long, in the place of `text`."""
    others = [f for f in docs.schema if f.name != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    return docs.mapInArrow(_with_fingerprint, ", ".join([*fields, "fp long"]))


# --- Golay code -----------------------------------------------------------------------------


def _remainder(word: int) -> int:
    for shift in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECK_BITS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each byte at three places, and the error that each remainder stands for."""
    parts = np.array(
        [[_remainder((b << 8 * k) & (1 << CODE_BITS) - 1) for b in range(256)] for k in range(3)],
        np.uint32,
    )
    single = [_remainder(1 << i) for i in range(CODE_BITS)]
    errors = np.zeros(1 << CHECK_BITS, np.uint32)
    for i in range(CODE_BITS):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return parts, errors


_PARTS, _ERRORS = _tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    rest = _PARTS[0][words & 255] ^ _PARTS[1][words >> 8 & 255] ^ _PARTS[2][words >> 16]
    return (words ^ _ERRORS[rest]) >> CHECK_BITS


def near_indices(words: np.ndarray, width: int) -> np.ndarray:
    """Indices of the codewords that the word and all within one bit of it decode to: rows of six,
    -1 where there are fewer."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
    found = np.sort(codeword_index(words.astype(np.uint32)[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(words), 6), -1, np.int64)
    place = np.cumsum(new, axis=1) - 1
    row, column = np.nonzero(new)
    out[row, place[row, column]] = found[row, column]
    return out


def link_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that two fingerprints within 3 bits share a key. A key holds the
    number of its case in the bits from 40 on."""
    cut = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = [near_indices(x, w) for x, (_, w) in zip(cut, SEGMENTS, strict=True)]
    rows, keys = [], []

    def add(case: int, there: np.ndarray, values: np.ndarray) -> None:
        row = np.nonzero(there)[0]
        rows.append(row)
        keys.append(values[there] | case << 40)

    case = 0
    for same, other in permutations(range(3), 2):
        add(case, near[other] >= 0, cut[same][:, None] << 12 | near[other])
        case += 1
    pair = (near[0][:, :, None] << 12 | near[1][:, None, :]).reshape(len(fps), 36)
    there = ((near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :]).reshape(len(fps), 36)
    for start, width in HALVES:
        half = ((fps >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
        add(case, there, pair << 11 | half[:, None])
        case += 1
    return np.concatenate(rows), np.concatenate(keys)


# --- links ----------------------------------------------------------------------------------


def _keyed(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            fps = batch.column("fp").slice(at, 5000).to_numpy(zero_copy_only=False)
            row, keys = link_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[row])], ["key", "fp"])


def spanning_links(fps: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links within `most_bits` that connect whatever such links connect: one fewer than the
    fingerprints of each group, not all pairs. Each fingerprint found is compared with those not
    yet reached."""
    bits = fps.view(np.uint64)
    rest, links = np.arange(len(fps)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = np.bitwise_count(bits[rest] ^ bits[at]) <= most_bits
            found = rest[close]
            links += [(int(fps[at]), int(fps[j])) for j in found]
            queue += found.tolist()
            rest = rest[~close]
    return links


def _linked(batches):
    """Links among rows with equal keys, which stand together: batches are sorted by key."""
    held = np.empty((0, 3), np.int64)

    def within(rows):
        """Links of all groups in rows, which hold whole groups."""
        change = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(rows)]])
        sizes = np.diff(starts)
        out = []
        two = starts[:-1][sizes == 2]
        a, b = rows[two, 2], rows[two + 1, 2]
        near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= MOST_BITS
        out += list(zip(a[near].tolist(), b[near].tolist(), strict=True))
        for i in np.flatnonzero(sizes > 2):
            out += spanning_links(rows[starts[i] : starts[i + 1], 2])
        return out

    def frame(links):
        a, b = zip(*links, strict=True) if links else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "pair", "fp")], 1)
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        last = np.any(rows[:, :2] != rows[-1, :2], axis=1)
        whole = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if whole:
            yield frame(within(rows[:whole]))
        held = rows[whole:]
    if len(held):
        yield frame(within(held))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all within 3 bits.

    A key that over BLOCK fingerprints share is cut into blocks, and every pair of blocks is
    compared in a group of its own, so no task holds more than two blocks of one key and each
    gives fewer links than it holds rows."""
    # A fingerprint has some 90 keys, so few bytes of input are much work: as many tasks as may be.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.repartition(tasks, "fp").mapInArrow(_keyed, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Keys that only one fingerprint has go no further. There are more keys than fingerprints, which
    # Spark's size of the frame doesn't tell, so the join is named: no broadcast.
    shared = keyed.join(sizes.hint("merge"), "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: (F.least(own, other) * blocks + F.greatest(own, other)).cast("long"),
    )
    dealt = shared.select(
        "key",
        F.explode(F.when(F.col("n") <= BLOCK, F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair"),
        "fp",
    )
    together = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return together.mapInArrow(_linked, "a long, b long")


def _classed(docs: DataFrame, *own: str) -> DataFrame:
    """(own columns, fp, root, component_id) of each document. Equal fingerprints are one node,
    whatever the number of their documents; root names the component also where ids are null."""
    rows = stored(fingerprinted(docs.select(*own, "text")), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"))).hint("merge")  # as many rows as there are texts
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids.hint("merge"), "root").select("fp", "root", "component_id")
    return rows.join(stored(classes, "classes").hint("merge"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, fingerprint, component_id.

    Null or empty text: fingerprint zero, linked like any other. Null doc_id: in a component with
    others, their smallest id; alone, null. Repeated rows: each comes back. No rows: none."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _classed(docs, "doc_id").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id and, of rows with that id, the
    smallest key of all its columns. Rows equal in all columns are one."""
    plain = numbered(docs)
    doc_id, text = (f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    keyed = plain.withColumn("key", row_key(plain.columns))
    named = keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "key")
    best = _classed(named, "doc_id", "key").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    )
    winners = best.select(F.col("best.key").alias("key"))
    kept = keyed.join(winners.hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*plain.columns).toDF(*docs.columns)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
