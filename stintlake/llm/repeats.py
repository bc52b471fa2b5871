"""Suffix-array dedup: maximal repeats of at least LENGTH bytes, within and across documents.

A suffix array of all positions would be far larger than the text. This one holds only anchors:
of the GRAM-byte hashes inside every window of LENGTH bytes the smallest, the rightmost of equal
ones. Equal windows have the same anchor at the same place, so a repeat is found at its anchors.
An anchor stands for the windows that chose it, and its context is the bytes of these windows.

1. Anchors are counted by the hash of their gram; those that stand alone go no further.
2. Anchors with equal contexts are one entry. If it occurs twice, all its windows repeat.
3. Entries with one gram and different contexts form an enhanced suffix array: sorted by the bytes
   from the anchor on, with the common prefixes of neighbours. A stack scan lists the intervals of
   the common-prefix tree. In each, the entries are sorted by the bytes left of the anchor; where
   neighbours share enough on both sides they belong to one repeat, which reaches as far left as
   all agree and ends where what stands left of them differs.
4. A gram with very many different contexts is cut by a longer key: entries whose windows reach
   far to the left, and those whose windows reach far to the right, form groups of their own, in
   halves down to single windows, until every group is small.
5. What repeats around an entry is joined back to all its occurrences, and spans are united.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.llm.common import stored, table

LENGTH = 200
GRAM = 56
#: Grams in a window, and so the most bytes of a window that stand left of its anchor, plus one.
GRAMS = LENGTH - GRAM + 1
#: Window starts handled at a time.
SLICE = 1_000_000
#: Entries of one group that a task sorts at once; larger groups are cut first.
GROUP = 1000

_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F
_PLACE = (1 << 24) - 1
_U = np.uint64


# --- anchors --------------------------------------------------------------------------------


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    ups, downs = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


class _Rolling:
    """Hashes of any stretch of some bytes, by prefix sums."""

    tables: dict = {}

    def __init__(self, data: np.ndarray, base: int):
        known = self.tables.get(base)
        if known is None or len(known[0]) < len(data) + 1:
            self.tables[base] = known = _powers(base, max(2 * len(data), 1 << 16))
        self.down = known[1]
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * known[0][: len(data)], out=self.sums[1:])

    def of(self, starts, ends) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` successive values."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :])


def anchors(data: bytes):
    """(position, before, after, gram hash, context hash) of each anchor: the context begins
    `before` bytes left of the anchor and ends `after` bytes right of its start."""
    windows = len(data) - LENGTH + 1
    for first in range(0, windows, SLICE):
        count = min(SLICE, windows - first)
        # An anchor whose windows lie in two slices is told twice, each time with its windows there.
        part = np.frombuffer(data, np.uint8, count + LENGTH - 1, first)
        rolling = _Rolling(part, _BASE)
        at = np.arange(len(part) - GRAM + 1)
        grams = rolling.of(at, at + GRAM)
        key = grams & ~_U(_PLACE) | (_U(_PLACE) - at.astype(_U))
        chosen = (_U(_PLACE) - (_least_of(key, GRAMS) & _U(_PLACE))).astype(np.int64)
        starts = np.flatnonzero(np.diff(chosen, prepend=-1))
        ends = np.append(starts[1:], count) - 1  # first and last window of each anchor
        place = chosen[starts]
        last = ends + LENGTH
        size = (place - starts).astype(_U) << _U(16) | (last - place).astype(_U)
        context = _mixed(_Rolling(part, _OTHER).of(starts, last) + size)
        yield place + first, place - starts, last - place, grams[place], context


def _anchored(batches):
    names = ["u", "v", "at", "gram", "context"]
    for batch in batches:
        us, vs = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        rows, held = [], 0
        for i, text in enumerate(batch.column("text")):
            data = (text.as_py() or "").encode()
            for place, before, after, gram, context in anchors(data):
                at = place << 16 | before << 8 | after
                n = len(place)
                rows.append((np.full(n, us[i]), np.full(n, vs[i]), at, gram.view(np.int64), context.view(np.int64)))
                held += n
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names)


# --- enhanced suffix array ------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int]):
    """(common prefix, first, last) of the intervals of the common-prefix tree, inner ones first;
    lcp[i] belongs to entries i and i + 1."""
    stack = [(0, 0)]
    for i, value in enumerate([*lcp, 0]):
        first = i
        while stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i
        if stack[-1][0] < value:
            stack.append((value, first))


def repeats(rights: list[bytes], lefts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by `rights`: the least and most bytes left of the anchor at which a
    window that repeats begins; LENGTH and -1 where none does. `lefts` run away from the anchor.

    An interval whose entries share `ahead` bytes from the anchor on holds the repeats that end
    there. Its entries in the order of what stands left of them: neighbours that share `back`
    bytes, back + ahead >= LENGTH, occur in one repeat, which starts `back` bytes left of the
    anchor; entries that differ there bound it. All members of a run are its occurrences."""
    n = len(rights)
    least, most = np.full(n, LENGTH), np.full(n, -1)
    ahead = [common(a, b) for a, b in zip(rights, rights[1:], strict=False)]
    if n == 2:
        back = common(*lefts)
        if back + ahead[0] >= LENGTH:
            least[:], most[:] = LENGTH - ahead[0], back
        return least, most
    order = sorted(range(n), key=lefts.__getitem__)
    sorted_lefts = [lefts[i] for i in order]
    shared = [common(a, b) for a, b in zip(sorted_lefts, sorted_lefts[1:], strict=False)]
    shared = np.array([*shared, 0])
    order = np.array(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    for length, first, last in intervals(ahead):
        inside = np.sort(rank[first : last + 1])
        back = np.minimum.reduceat(shared, inside)[:-1]
        near = np.flatnonzero(back >= LENGTH - length)
        for side in (inside[near], inside[near + 1]):
            member = order[side]
            least[member] = np.minimum(least[member], LENGTH - length)
            np.maximum.at(most, member, back[near])
    return least, most


def _scanned(batches):
    """Rows (gram, context, least, most) of entries around which something repeats. Batches are
    sorted by gram and by what stands right of the anchor; equal entries are merged."""
    held = []

    def group(rows):
        merged, times = [], []
        for row in rows:
            if merged and row[2:4] == merged[-1][2:4]:
                times[-1] += row[4]
            else:
                merged.append(row)
                times.append(row[4])
        if len(merged) > 1:
            least, most = repeats([r[2] for r in merged], [r[3] for r in merged])
        else:
            least, most = np.array([LENGTH]), np.array([-1])
        out = []
        for row, n, a, b in zip(merged, times, least.tolist(), most.tolist(), strict=True):
            if n > 1:  # the entry itself occurs twice: all its windows repeat
                a, b = min(a, LENGTH - len(row[2])), max(b, len(row[3]))
            if b >= 0:
                out.append((row[0], row[1], a, b))
        return out

    def frame(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["gram", "context", "least", "most"]
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("gram", "context", "right", "left", "n")]
        found = []
        for row in zip(*columns, strict=True):
            if held and held[-1][0] != row[0]:
                found += group(held)
                held = []
            held.append(row)
        yield frame(found)
    if held:
        yield frame(group(held))


SCANNED = "gram long, context long, least long, most long"
ENTRY = "gram long, context long, right binary, left binary, n long"


def _scan(entries: DataFrame) -> DataFrame:
    together = entries.repartition("gram").sortWithinPartitions("gram", "right", "left")
    return together.mapInArrow(_scanned, SCANNED)


def _halved(batches):
    """Both halves of each entry's windows, by how far they reach left: `lo`..`hi` bytes. All
    windows of a half share the bytes from `lo` left to LENGTH - `hi` right of the anchor, which
    name its group, and need nothing beyond `hi` left and LENGTH - `lo` right."""
    names = ["origin_gram", "origin", "lo", "hi", "gram", "context", "right", "left", "n"]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("origin_gram", "origin", "lo", "hi", "right", "left", "n")]
        rows = []
        for gram, origin, lo, hi, right, left, n in zip(*columns, strict=True):
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle + 1, hi)):
                if a > b or len(left) < a or len(right) < LENGTH - b:
                    continue
                near, far = left[:b], right[: LENGTH - a]
                core = b"%d %d " % (a, b) + left[:a] + b" " + right[: LENGTH - b]
                key = np.array([xxhash.xxh64_intdigest(core)], _U).view(np.int64)[0]
                whole = b"%d " % len(near) + near + far
                name = np.array([xxhash.xxh64_intdigest(whole, 1)], _U).view(np.int64)[0]
                rows.append((gram, origin, a, b, int(key), int(name), far, near, n))
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        kinds = [pa.int64()] * 6 + [pa.binary()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


HALVED = "origin_gram long, origin long, lo long, hi long, " + ENTRY


def _found(entries: DataFrame) -> DataFrame:
    """What repeats around the entries of grams with different contexts: stored entries in, rows
    (gram, context, least, most) out. Groups of over GROUP entries are cut until none is left;
    a group of single windows has one context, so the cutting ends after 8 halvings."""
    rows = entries.select(
        F.col("gram").alias("origin_gram"), F.col("context").alias("origin"),
        F.lit(0).cast("long").alias("lo"), F.lit(GRAMS - 1).cast("long").alias("hi"), "*",
    )
    done = []
    while True:
        different = rows.groupBy("gram").agg(F.count_distinct("context").alias("m"))
        large = stored(different.where(F.col("m") > GROUP).select("gram"), "large-groups")
        any_large = not large.isEmpty()
        small = rows.join(large, "gram", "left_anti") if any_large else rows
        if not done:
            done.append(_scan(small.select("gram", "context", "right", "left", "n")))
        else:
            # What is cut off makes many entries equal: they are merged before they meet.
            merged = small.groupBy("gram", "context").agg(
                F.first("right").alias("right"), F.first("left").alias("left"), F.sum("n").alias("n")
            )
            scanned = _scan(merged.select("gram", "context", "right", "left", "n"))
            back = small.select("origin_gram", "origin", "gram", "context").distinct()
            done.append(
                back.join(stored(scanned, "repeats"), ["gram", "context"]).select(
                    F.col("origin_gram").alias("gram"), F.col("origin").alias("context"), "least", "most"
                )
            )
        if not any_large:
            break
        rows = stored(rows.join(large, "gram", "left_semi").mapInArrow(_halved, HALVED), "halves")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


# --- documents ------------------------------------------------------------------------------


def _cut_out(batches):
    """Entries (gram, context, right, left, n) of the places wanted in each text."""
    names = ["gram", "context", "right", "left", "n"]
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            data = text.as_py().encode()
            for x in wanted.as_py():
                at, before, after = x["at"] >> 16, x["at"] >> 8 & 255, x["at"] & 255
                left = data[at - before : at][::-1]
                rows.append((x["gram"], x["context"], data[at : at + after], left, x["n"]))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, u, v): rows with equal u and v have the same id and, by 64 bits, the same
    text, and so the same repeats."""
    return docs.select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("u"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("v"),
    )


def repeat_spans(docs: DataFrame) -> DataFrame:
    """(u, v, spans) of the documents in which something repeats: spans is an array of (start,
    end) bytes that may overlap. A row more of the same id and text repeats it, too."""
    keyed = _keyed(docs)
    every = stored(
        keyed.select("u", "v", "text").mapInArrow(
            _anchored, "u long, v long, at long, gram long, context long"
        ),
        "anchors",
    )
    shared = stored(
        every.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"), "grams"
    )
    occurrences = stored(every.join(shared, "gram", "left_semi"), "occurrences")
    contexts = stored(
        occurrences.groupBy("gram", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("u", "v", "at")).alias("one")
        ),
        "contexts",
    )
    different = stored(
        contexts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"),
        "mixed-grams",
    )
    wanted = (
        contexts.join(different, "gram", "left_semi")
        .groupBy("one.u", "one.v")
        .agg(
            F.collect_list(F.struct(F.col("one.at").alias("at"), "gram", "context", "n")).alias("wanted")
        )
    )
    entries = stored(
        keyed.select("u", "v", "text").join(wanted, ["u", "v"]).mapInArrow(_cut_out, ENTRY), "entries"
    )
    # Contexts that occur twice repeat whole.
    whole = contexts.where("n > 1").select(
        "gram",
        "context",
        (LENGTH - F.col("one.at").bitwiseAND(F.lit(255).cast("long"))).alias("least"),
        F.shiftright("one.at", 8).bitwiseAND(F.lit(255).cast("long")).alias("most"),
    )
    around = stored(
        _found(entries)
        .union(whole)
        .groupBy("gram", "context")
        .agg(F.min("least").alias("least"), F.max("most").alias("most")),
        "around",
    )
    place = F.shiftright("at", 16)
    spans = occurrences.join(around, ["gram", "context"]).select(
        "u", "v",
        F.struct(
            (place - F.col("most")).alias("start"), (place + LENGTH - F.col("least")).alias("end")
        ).alias("span"),
    )
    return spans.groupBy("u", "v").agg(F.collect_set("span").alias("spans"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in the spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _removed(batches):
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = (text.as_py() or "").encode()
            runs = united([(x["start"], x["end"]) for x in spans.as_py() or []])
            kept, at = hashlib.sha256(), 0
            for start, end in runs:
                kept.update(data[at:start])
                at = end
            kept.update(data[at:])
            rows.append((len(data), sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column("spans")],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges
    that may overlap; null for none).

    Every byte that a string of LENGTH bytes covers which also starts elsewhere is removed, all
    occurrences alike. Null or empty text, and texts under LENGTH bytes: nothing is removed.
    Repeated rows: all bytes of each are, from LENGTH bytes on. No rows: none."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = stored(repeat_spans(docs), "spans")
    joined = _keyed(docs).join(spans, ["u", "v"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        _removed,
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,end:long>>",
    )


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("spans")
