"""Repair of conversations by iterative-deepening A*.

A conversation is repaired by the cheapest edits (Delete, Insert, Keep, Rerole) after which its
roles read `(s?(ua)+)?`. The search goes depth first through the edits in ASCII order under a bound
on the cost; states that failed are kept in a table with the cost that they need at least, which
also gives the next bound. The first path that arrives within the least bound is the answer:
the cheapest edits, and of equally cheap ones the ASCII-least.

Conversations are cut into pieces of PIECE rows. Of a piece that is not the only one, the search is
made from every role it may begin behind to every role it may end with, and a conversation's
pieces are chained over a table with a few numbers for each. An insert belongs to the row behind it,
so two different paths through a piece differ inside it and ASCII order is kept.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.functions.ordered import joined
from stintlake.llm.common import stored, table

PIECE = 256
#: Results of searches that a task keeps.
KEPT = 50_000
WHITE = " \t\n\x0b\x0c\r"

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: What stands before: nothing, a system, a user, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: The exit of a conversation's last piece: any accepted one.
END = -1
NO_WAY = 1 << 30


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that crc32(`conv_id:turn`) % 20 names. Null role
    and text, and null parts of the key, are one space."""
    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = (
        F.when(fate == 1, F.lit(""))
        .when(fate == 2, F.translate(part("text"), ".!?", ""))
        .otherwise(part("text"))
    )
    role = F.when(fate == 4, F.lit("user")).otherwise(part("role"))
    times = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("_fate"), times.alias("_times"))
        .where("_fate <> 0")
        .select("conv_id", "turn", "role", "text", F.explode("_times").alias("_time"))
        .drop("_time")
    )


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Adds `pos`, the place in the conversation by turn (nulls first; ties by role and text, then
    equal), `initial`, `blank`, `cut` (truncated), `illegal` (not a pair with the row before),
    `new_turn`, and `digest` of role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    before = F.lag("initial").over(order)
    pair = F.concat(before, F.col("initial"))
    return (
        rows.withColumns({"initial": initial, "_bare": bare})
        .withColumns(
            {
                "pos": F.row_number().over(order).cast("long"),
                "blank": F.col("_bare") == "",
                "cut": ~F.substring("_bare", -1, 1).isin(".", "!", "?"),
                "illegal": before.isNotNull() & ~pair.isin("su", "ua", "au"),
                "new_turn": F.col("turn").isNotNull()
                & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)),
                "digest": F.struct(
                    F.xxhash64("role", "text").alias("a"),
                    F.xxhash64(F.lit(7), "text", "role").alias("b"),
                ),
            }
        )
        .drop("_bare")
    )


def pieces(rows: DataFrame) -> DataFrame:
    """A row per piece of a conversation: its counts, and `codes` with a letter per row: `-` must
    go; else the initial (x for any but s, u, a), in upper case if the row is truncated."""
    light = rows.drop("role", "text")
    firsts = light.groupBy("conv_id", "digest").agg(F.min("pos").alias("_first"))
    marked = joined(light, firsts, ["conv_id", "digest"]).withColumn(
        "repeat", ~F.col("blank") & (F.col("pos") > F.col("_first"))
    )
    gone = F.col("blank") | F.col("repeat")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(gone, "-").when(F.col("cut"), F.upper(letter)).otherwise(letter)
    return (
        marked.withColumn("piece", F.floor((F.col("pos") - 1) / F.lit(PIECE)))
        .groupBy("conv_id", "piece")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("pos", code.alias("code")))), lambda x: x["code"]
                ), "",
            ).alias("codes"),
            F.min("turn").alias("least"), F.max("turn").alias("most"),
            F.count_if("new_turn").alias("turns"),
            F.count_if("blank").alias("blank"),
            F.count_if("repeat").alias("duplicate"),
            F.count_if(~gone & F.col("cut")).alias("truncated"),
            F.count_if("illegal").alias("illegal"),
        )
    )


# --- search -------------------------------------------------------------------------------------


def needs(codes: str) -> list[int]:
    """For every place, what the rows from there on cost at least: rows that must go, truncated rows
    (2, to delete them), and 1 for each of as many neighbouring pairs as there are without a common
    row, among the others, that can't stand behind each other."""
    n = len(codes)
    out, fixed = [0] * (n + 1), 0
    ahead: list[tuple[str, int]] = []  # the clean rows from here on, the nearest last, with pairs
    for i in range(n - 1, -1, -1):
        x = codes[i]
        if x in "suax":
            pairs = ahead[-1][1] if ahead else 0
            if ahead and x + ahead[-1][0] not in ("su", "ua", "au"):
                pairs = max(pairs, 1 + (ahead[-2][1] if len(ahead) > 1 else 0))
            ahead.append((x, pairs))
        else:
            fixed += DELETE
        out[i] = fixed + (ahead[-1][1] if ahead else 0)
    return out


def search(codes: str, begin: int, exits: tuple[int, ...], closing: bool) -> tuple[int, str]:
    """The least cost and the ASCII-least of its audits that lead from the state `begin` over all
    rows to one of `exits`; NO_WAY if none does. Inserts behind the last row only if `closing`."""
    n, least = len(codes), needs(codes)
    failed: dict[tuple[int, int], int] = {}

    def edits(i, state):
        after = ASSISTANT if state == USER else USER
        x = codes[i] if i < n else ""
        if x:
            yield "D", DELETE, i + 1, state
        if x or closing:
            yield "I", INSERT, i, after
        if x and x != "-":
            late = TRUNCATED if x.isupper() else 0
            kept = x.lower()
            if kept == "s" and state == START:
                yield "K", late, i + 1, SYSTEM
            elif kept == ("a" if state == USER else "u"):
                yield "K", late, i + 1, after
            yield "R", REROLE + late, i + 1, after

    def dive(i, state, rest):
        if i == n and state in exits:
            return ""
        lowest = NO_WAY
        for name, cost, at, then in edits(i, state):
            more = max(least[at], failed.get((at, then), 0))
            if cost + more <= rest:
                behind = dive(at, then, rest - cost)
                if behind is not None:
                    return name + behind
                more = failed[(at, then)]
            lowest = min(lowest, cost + more)
        failed[(i, state)] = lowest
        return None

    bound, most = least[0], DELETE * n + 3 * INSERT  # to delete all and insert what is missing
    while bound <= most:
        audit = dive(0, begin, bound)
        if audit is not None:
            return bound, audit
        bound = failed[(0, begin)]
    return NO_WAY, ""


def ways(codes: str, first: bool, last: bool):
    """(begin, exit, cost, audit, rank) of a piece; rank orders the audits of a begin."""
    for begin in (START,) if first else range(4):
        exits = [(END, ACCEPTED)] if last else [(x, (x,)) for x in range(4)]
        found = [(x, *search(codes, begin, goals, last)) for x, goals in exits]
        audits = sorted(audit for _, cost, audit in found if cost < NO_WAY)
        for x, cost, audit in found:
            if cost < NO_WAY:
                yield begin, x, cost, audit, audits.index(audit)


def _solved(batches):
    kept: dict = {}
    for batch in batches:
        rows, out = [], []
        codes, piece, count = (batch.column(c).to_pylist() for c in ("codes", "piece", "count"))
        for i, (x, k, n) in enumerate(zip(codes, piece, count, strict=True)):
            key = x, k == 0, k == n - 1
            if key not in kept:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[key] = list(ways(*key))
            rows += [i] * len(kept[key])
            out += kept[key]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(take) for c in ("conv_id", "piece", "count")]
            + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["conv_id", "piece", "count", "begin", "exit", "cost", "audit", "rank"],
        )


def _chained(rows: pa.Table) -> pa.Table:
    """Of the ways through a conversation's pieces, those of the cheapest, ASCII-least chain."""
    order = np.argsort(rows["piece"].to_numpy(), kind="stable")
    found = rows.take(pa.array(order))
    piece, begin, to, cost, rank = (
        found[c].to_numpy() for c in ("piece", "begin", "exit", "cost", "rank")
    )
    cuts = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(piece))
    behind, best = {END: 0}, [0] * (len(cuts) - 1)
    for k in range(len(cuts) - 2, -1, -1):
        now: dict[int, tuple] = {}
        for i in range(cuts[k], cuts[k + 1]):
            if int(to[i]) in behind:
                way = int(cost[i]) + behind[int(to[i])], int(rank[i]), i
                now[int(begin[i])] = min(now.get(int(begin[i]), way), way)
        best[k], behind = now, {state: way[0] for state, way in now.items()}
    picked, state = [], START
    for now in best:
        picked.append(now[state][2])
        state = int(to[picked[-1]])
    return found.take(pa.array(picked, pa.int64())).select(["conv_id", "piece", "begin", "exit"])


def repairs(found: DataFrame) -> DataFrame:
    """(conv_id, piece, begin, cost, audit) of the repair of each piece."""
    kind = found.schema["conv_id"].dataType.simpleString()
    counted = found.select(
        "conv_id", "piece", "codes", F.count("*").over(Window.partitionBy("conv_id")).alias("count")
    )
    ways_out = (
        f"conv_id {kind}, piece long, count long, begin int, exit int, cost long, audit string, rank int"
    )
    # A search takes long for its few bytes, so pieces are dealt to as many tasks as there may be.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartition(tasks, "conv_id", "piece")
    solved = stored(dealt.mapInArrow(_solved, ways_out), "repair-ways")
    wanted = ["conv_id", "piece", "begin", "cost", "audit"]
    whole = solved.where("count = 1").select(*wanted)
    several = solved.where("count > 1")
    # The audits, as long as their pieces, stay behind; a few numbers a piece make the chain.
    chain = (
        several.drop("audit", "count").groupBy("conv_id")
        .applyInArrow(_chained, f"conv_id {kind}, piece long, begin int, exit int")
        .withColumn("_on", F.lit(True))
    )
    chosen = joined(several, chain, ["conv_id", "piece", "begin", "exit"]).where("_on")
    return whole.union(chosen.select(*wanted))


# --- repaired text --------------------------------------------------------------------------------


class Repaired:
    """The digest of a conversation while its pieces and rows pass by in order."""

    def __init__(self):
        self.digest, self.any, self.state = hashlib.sha256(), False, START
        self.audit, self.at = "", 0

    def _add(self, role: bytes, text: bytes) -> None:
        if self.any:
            self.digest.update(b"\n")
        self.digest.update(role + b":")
        self.digest.update(text)
        self.any = True

    def _next(self) -> bytes:
        self.state = ASSISTANT if self.state == USER else USER
        return b"assistant" if self.state == ASSISTANT else b"user"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._add(self._next(), b"")
            self.at += 1

    def piece(self, audit: str) -> None:
        self.audit, self.at = audit, 0

    def row(self, role: bytes, text: bytes) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K" and role[:1] == b"s":
            self.state = SYSTEM
            self._add(role, text)
        elif edit != "D":
            named = self._next()
            self._add(role if edit == "K" else named, text)

    def done(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def _digested(batches):
    now, conv, kind = None, None, None

    def frame(rows):
        ids, digests = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"]
        )

    for batch in batches:
        kind, rows = batch.schema.field("conv_id").type, []
        columns = [batch.column(c) for c in ("conv_id", "piece", "audit", "role", "text")]
        for conv_id, piece, audit, role, text in zip(*columns, strict=True):
            if audit.is_valid:
                if piece.as_py() == 0:
                    if now:
                        rows.append((conv, now.done()))
                    now, conv = Repaired(), conv_id.as_py()
                now.piece(audit.as_py())
            else:
                now.row(role.as_py(), text.as_py())
        yield frame(rows)
    if now:
        yield frame([(conv, now.done())])


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256). Rows and audits of a conversation pass one task, which a digest
    can't do without; sorted, one at a time, an audit before the rows of its piece."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    texts = rows.select(
        "conv_id", F.floor((F.col("pos") - 1) / F.lit(PIECE)).alias("piece"), "pos",
        F.lit(None).cast("string").alias("audit"),
        F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"),
    )
    empty = F.lit(None).cast("binary")
    heads = audits.select(
        "conv_id", "piece", F.lit(0).cast("long").alias("pos"), "audit", empty.alias("role"), empty.alias("text")
    )
    return (
        texts.unionByName(heads)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "piece", "pos")
        .mapInArrow(_digested, f"conv_id {kind}, repaired_sha256 string")
    )


# --- the operator -----------------------------------------------------------------------------


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per conversation of `conversations`: faults and the cheapest repair of its `rows`
    (conv_id, turn, role, text; no nulls in role and text).

    Order: by turn, nulls first, then role and text. A null conv_id is a conversation. Conversations
    without rows: zeros, empty audit, the digest of nothing. Repeated rows are duplicates. A span
    of turns beyond a long gives null gaps. No conversations: no rows. Other columns are not
    looked at."""
    numbered = stored(numbered_rows(rows.select("conv_id", "turn", "role", "text")), "turns")
    found = stored(pieces(numbered), "pieces")
    audits = stored(repairs(found), "repairs")
    span = F.try_subtract(F.max("most"), F.min("least"))
    gaps = F.try_subtract(F.try_add(span, F.lit(1)), F.sum("turns"))
    counts = found.groupBy("conv_id").agg(
        F.when(F.count("most") == 0, 0).otherwise(gaps).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.lit(True).alias("_rows"),
    )
    edits = audits.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), ""
        ).alias("audit"),
    )
    every = conversations.select("conv_id").distinct()
    for part in (counts, edits, digests(numbered, audits)):
        every = joined(every, part, ["conv_id"])
    nothing = hashlib.sha256().hexdigest()
    numbers = [
        F.when(F.col("_rows").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c)
        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ]
    return every.select(
        "conv_id", *numbers,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def op13_conversation_structure_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired(conversations, damaged(conversations))
