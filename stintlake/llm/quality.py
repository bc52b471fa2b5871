"""Quality rules: base counts and zstandard compression bands.

Text that compresses too well repeats itself, text that hardly compresses is noise. How well
clean text compresses depends on its length, so whole documents get a lower and an upper limit
per band of length (powers of two), and pieces of one fixed length get limits of their own.
"""

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.functions.groups import exact_quantiles
from stintlake.llm.common import numbered, stored, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Bytes of a fixed piece; what is left at the end of a text is judged with the whole only.
CHUNK = 2048
LEVEL = 3
#: Bands of length: powers of two of the bytes, 2 ** 7 and less to 2 ** 17 and more.
LOW_BAND, HIGH_BAND = 7, 17
#: Ratios are counted in bins of this width before those of a bin are sorted.
RATIO_BIN = 0.001
#: The share of good rows that each limit leaves inside, and room beyond it as a share of the
#: distance from their median.
INSIDE = 0.999
ROOM = 0.25
#: Fewer good rows than this set no limit for their band; it borrows from the next bands.
FEWEST = 30
#: Limits without any labelled rows.
GENEROUS = (0.9, 6.0)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    """Lowest and highest ratio for whole texts by band, and for fixed pieces."""

    whole: dict
    chunk: tuple = GENEROUS

    def of(self, band: int) -> tuple:
        return self.whole.get(band, GENEROUS)


def band_of(n_bytes: int) -> int:
    return min(HIGH_BAND, max(LOW_BAND, n_bytes.bit_length() - 1))


def ratios(data: bytes, compress) -> tuple[float, float, float]:
    """Bytes over compressed bytes: of the whole, and the least and greatest of the fixed pieces
    (1.0 for no text, the whole's where there is no piece). The last piece ends with the text, so
    every byte of a text with pieces is in one."""
    if not data:
        return 1.0, 1.0, 1.0
    whole = len(data) / len(compress(data))
    starts = list(range(0, len(data) - CHUNK + 1, CHUNK))
    if starts and len(data) % CHUNK:
        starts.append(len(data) - CHUNK)
    pieces = [CHUNK / len(compress(data[at : at + CHUNK])) for at in starts]
    return whole, min(pieces, default=whole), max(pieces, default=whole)


def roomy(low: float, median: float, high: float) -> tuple[float, float]:
    """Limits from quantiles of good rows, a margin wider."""
    return low - ROOM * (median - low), high + ROOM * (high - median)


def borrowed(whole: dict[int, tuple]) -> dict[int, tuple]:
    """Limits of all bands from those that have some. Ratios rise with length; a band beyond the
    last known one goes on as the last two did on its far side, and keeps the near limit. A band in
    between spans both its neighbours."""
    known = sorted(whole)
    out = dict(whole)
    for band in range(LOW_BAND, HIGH_BAND + 1) if known else ():
        below = [b for b in known if b < band]
        above = [b for b in known if b > band]
        if band in whole:
            continue
        if below and above:
            a, b = whole[below[-1]], whole[above[0]]
            out[band] = min(a[0], b[0]), max(a[1], b[1])
        elif below:
            last = whole[below[-1]]
            rise = max(0.0, last[1] - whole[below[-2]][1]) if len(below) > 1 else 0.0
            out[band] = last[0], last[1] + rise * (band - below[-1])
        else:
            first = whole[above[0]]
            fall = max(0.0, whole[above[1]][0] - first[0]) if len(above) > 1 else 0.0
            out[band] = first[0] - fall * (above[0] - band), first[1]
    return out


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > 2_000_000:  # so that three ids fit into 64 bits
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        grams = pairs[:-1] * len(number) + ids[2:]
    else:
        grams = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= twice
    return int(covered.sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    if not words:
        return 0, 0, 0, 0, 0
    inside = b"".join(words)
    # A code point has one byte that doesn't continue another.
    codes = np.frombuffer(inside, np.uint8)
    chars = int(np.count_nonzero((codes & 0xC0) != 0x80))
    symbols = len(inside) - len(inside.translate(None, b"#*$%&|<>"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, chunk_low double, chunk_high double"
)


def _measured(batches, column):
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        rows = []
        for text in batch.column(column):
            data = text.as_py()
            data = b"" if data is None else data.encode()
            rows.append((*base_counts(data), len(data), *ratios(data, compress)))
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        kinds = [pa.int64()] * 6 + [pa.float64()] * 3
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        names = [x.split()[0] for x in MEASURES.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])


def measure(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds the base counts and the compression ratios of the texts in `column`."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(partial(_measured, column=column), f"{fields}, {MEASURES}")


def fit_limits(docs: DataFrame, labels: DataFrame) -> Limits:
    """Limits from all documents labelled good (quality 1)."""
    return limits_of(stored_measures(docs), labels)


def stored_measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every document, kept, as they are read several times."""
    return stored(measure(docs.select("doc_id", "text")).drop("text"), "measures")


def limits_of(measured: DataFrame, labels: DataFrame) -> Limits:
    """Limits from measured documents, all that are labelled good. Their quantiles are exact and no
    task holds a band; three for each band come to the driver. Without labelled rows the generous
    limits hold."""
    # Labels grow with the documents: no broadcast.
    good = labels.where("quality = 1").select("doc_id").distinct().hint("merge")
    clean = measured.join(good, "doc_id", "left_semi").where(~_base_failed())
    band = F.greatest(
        F.lit(LOW_BAND), F.least(F.lit(HIGH_BAND), F.length(F.bin("n_bytes")) - 1)
    )
    chunks = F.col("n_bytes") >= CHUNK

    def value(kind, at, name, there):
        return F.when(there, F.struct(F.lit(kind).alias("kind"), at.alias("band"), F.col(name).alias("value")))

    values = F.array_compact(
        F.array(
            value("whole", band.cast("int"), "ratio", F.lit(True)),
            value("low", F.lit(0), "chunk_low", chunks),
            value("high", F.lit(0), "chunk_high", chunks),
        )
    )
    rows = stored(clean.select(F.inline(values)), "ratios")
    by = ["kind", "band"]
    ends = {"least": 1 - INSIDE, "middle": 0.5, "most": INSIDE}
    found = exact_quantiles(rows, by, "value", ends, RATIO_BIN)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    known = {
        (r["kind"], r["band"]): roomy(r["least"], r["middle"], r["most"])
        for r in found.join(counts, by).where(F.col("n") >= FEWEST).collect()
    }
    whole = {at: ends for (kind, at), ends in known.items() if kind == "whole"}
    chunk = (known["low", 0][0], known["high", 0][1]) if ("low", 0) in known else GENEROUS
    return Limits(borrowed(whole), chunk)


def _base_failed():
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(measured: DataFrame, limits: Limits) -> DataFrame:
    """Adds base_failed, bands_ok and kept."""
    band = F.greatest(
        F.lit(LOW_BAND), F.least(F.lit(HIGH_BAND), F.length(F.bin("n_bytes")) - 1)
    )
    low, high = F.lit(GENEROUS[0]), F.lit(GENEROUS[1])
    for at, (least, most) in sorted(limits.whole.items()):
        low = F.when(band == at, F.lit(least)).otherwise(low)
        high = F.when(band == at, F.lit(most)).otherwise(high)
    whole = F.col("ratio").between(low, high)
    pieces = (F.col("n_bytes") < CHUNK) | (
        (F.col("chunk_low") >= limits.chunk[0]) & (F.col("chunk_high") <= limits.chunk[1])
    )
    return (
        measured.withColumn("base_failed", _base_failed())
        .withColumn("bands_ok", whole & pieces)
        .withColumn("kept", ~F.col("base_failed") & F.col("bands_ok"))
    )


def quality(docs: DataFrame, limits: Limits) -> DataFrame:
    """A row per document: doc_id, the base counts, the ratios, base_failed, bands_ok, kept.

    Null or empty text: all counts 0, base_failed. Repeated rows: judged each, alike. A text with
    fewer than 2,048 bytes is judged as a whole only. No rows: none. Other columns are ignored."""
    return judge(measure(docs.select("doc_id", "text")), limits)


def kept_documents(docs: DataFrame, limits: Limits) -> DataFrame:
    """The documents that pass, with their own columns."""
    plain = numbered(docs)
    measured = measure(plain, f"_{docs.columns.index('text')}")
    kept = judge(measured, limits).where("kept").select(*plain.columns)
    return kept.toDF(*docs.columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    measured = stored_measures(table(spark, sf_dir, "documents"))
    limits = limits_of(measured, table(spark, sf_dir, "labels"))
    return judge(measured, limits).select(
        "doc_id", *COUNTS, "base_failed", "kept", "ratio", "chunk_low", "chunk_high"
    )
