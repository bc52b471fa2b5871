"""Quotation linking: conversations in reply order without quotes, in DataFrame functions only.

A line's quote level is the number of > marks before its text. Successive lines of one level form
a quoted passage. Passages are hashed after lower-casing and joining white space, and joined to
the first message of the conversation that holds the same passage in its own words. A passage that
is found nowhere as a whole goes to the message that holds most of its lines and runs of words.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.llm.common import let, stored, table

MARKS = r"^(?:[ \t]*>)+"
QUOTED = r"(?m)^[ \t]*>"
#: A line that only announces a quote.
ANNOUNCED = r"(?i)^\s*on .{1,200} wrote:\s*$"
#: Words of a run by which trimmed quotes are found; shorter quotes are runs of their own.
RUN = 4
#: A trimmed quote has one of so many of its units at least in the message it is linked to.
SHARE = 4
#: What counts as a word in units: marks and punctuation at a cut don't.
UNIT_WORD = r"[\p{L}\p{N}\p{M}]+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passage_key(text: Column) -> Column:
    return F.md5(normalised(text))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(UNIT_WORD), F.lit(0))


def _runs(words: Column, length: int) -> Column:
    return F.when(
        F.size(words) >= length,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (length - 1)),
            lambda i: F.array_join(F.slice(words, i, length), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _units(text: Column, quoted: bool) -> Column:
    """Hashes of a text's lines and of all its runs of RUN words, also across lines. A quote of
    fewer words is one run; originals have their shorter runs too, so that it is found."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.array_join(_words(line), " "))
    if quoted:
        runs = let(
            _words(text),
            lambda w: F.when(F.size(w) < RUN, F.array(F.array_join(w, " "))).otherwise(_runs(w, RUN)),
        )
    else:
        runs = let(_words(text), lambda w: F.concat(*[_runs(w, n) for n in range(1, RUN + 1)]))
    named = F.filter(F.concat(lines, runs), lambda x: x != "")
    return F.array_distinct(F.transform(named, lambda x: F.xxhash64(x)))


def _levels(text: Column) -> Column:
    """The lines of a text as (level, words), marks taken off."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda line: let(
            F.regexp_extract(line, MARKS, 0),
            lambda marks: F.struct(
                (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
                F.trim(F.substring(line, F.length(marks) + 1, F.length(line))).alias("words"),
            ),
        ),
    )


def _passages(lines: Column) -> Column:
    """Quoted passages (level, words) in their order: runs of lines of one level; empty ones left
    out. A blank quoted line ends a passage, as a blank line ends a paragraph."""
    n = F.size(lines)
    above = F.concat(F.array(F.lit(-1)), F.slice(F.transform(lines, lambda x: x["level"]), F.lit(1), n - 1))
    fresh = F.zip_with(lines, above, lambda x, level: (x["level"] != level) | (x["words"] == ""))
    begins = F.array_compact(F.transform(fresh, lambda new, i: F.when(new, i)))

    def cut(first: Column, end: Column) -> Column:
        words = F.transform(F.slice(lines, first + 1, end - first), lambda x: x["words"])
        return F.struct(
            F.get(lines, first)["level"].alias("level"),
            F.array_join(F.filter(words, lambda x: x != ""), "\n").alias("words"),
        )

    runs = let(
        begins,
        lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(n)), cut),
    )
    return F.filter(runs, lambda p: (p["level"] > 0) & (p["words"] != ""))


def _own_words(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them, trimmed."""
    lines = F.filter(
        F.split(text, "\n", -1), lambda x: ~F.rlike(x, F.lit(MARKS)) & ~F.rlike(x, F.lit(ANNOUNCED))
    )
    return F.when(F.rlike(text, F.lit(QUOTED)), F.trim(F.array_join(lines, "\n"))).otherwise(text)


def parsed(messages: DataFrame) -> DataFrame:
    """Adds own_text and `passages` (level, key, units) to messages."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.when(
        F.rlike(text, F.lit(QUOTED)),
        F.transform(
            let(_levels(text), _passages),
            lambda p: F.struct(
                p["level"].alias("level"), passage_key(p["words"]).alias("key"),
                _units(p["words"], quoted=True).alias("units"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<level:int,key:string,units:array<bigint>>>"))
    return messages.withColumn("own_text", _own_words(text)).withColumn("passages", found)


def _passage_keys(own: Column) -> Column:
    """Keys under which a message may be quoted: all of it, its paragraphs, its lines."""
    units = F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n"))
    named = F.filter(units, lambda u: F.rlike(u, F.lit(r"\S")))
    return F.array_distinct(F.transform(named, passage_key))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) for messages that quote an earlier message of their
    conversation: reply_to is the latest turn quoted at the lowest level that was found.

    The first message with a passage counts as its origin: a minimum by partial aggregation, so a
    passage that stands in a third of all messages is no load. Only keys that are quoted somewhere
    are gathered. Passages without an origin are looked for by their units."""
    keyed = F.transform(
        "passages", lambda p: F.struct(p["level"].alias("level"), p["key"].alias("key"))
    )
    quotes = (
        messages.where(F.size("passages") > 0)
        .select("conv_id", "turn", F.explode(F.array_distinct(keyed)).alias("p"))
        .select("conv_id", "turn", "p.level", "p.key")
    )
    held = messages.select("conv_id", "turn", F.explode(_passage_keys(F.col("own_text"))).alias("key"))
    wanted = quotes.select("conv_id", "key").distinct()
    origins = (
        held.join(wanted, ["conv_id", "key"], "left_semi")
        .groupBy("conv_id", "key")
        .agg(F.min("turn").alias("origin"))
    )
    whole = stored(
        quotes.join(origins, ["conv_id", "key"]).where("origin < turn"), "whole-quotes"
    )
    found = whole.unionByName(_trimmed_links(messages, whole))
    return found.groupBy("conv_id", "turn").agg(
        F.min(F.struct("level", (-F.col("origin")).alias("back"))).alias("best"),
        F.count("*").alias("n_linked"),
    ).select("conv_id", "turn", (-F.col("best.back")).alias("reply_to"), "n_linked")


def _trimmed_links(messages: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv_id, key, turn, level, origin) of the passages that are not in `whole`: the earlier
    message that is the first with most of their units, with one of SHARE at least; the first of
    equal ones. Only messages of conversations with such passages are cut into units."""
    names = ["conv_id", "turn", "level", "key"]
    missing = stored(
        messages.where(F.size("passages") > 0)
        .select("conv_id", "turn", F.explode("passages").alias("p"))
        .select("conv_id", "turn", "p.level", "p.key", "p.units")
        .join(whole, names, "left_anti")
        .select(*names, F.explode("units").alias("unit"))
        .distinct(),
        "trimmed-quotes",
    )
    origins = (
        messages.join(missing.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(_units(F.col("own_text"), quoted=False)).alias("unit"))
        .join(missing.select("conv_id", "unit").distinct(), ["conv_id", "unit"], "left_semi")
        .groupBy("conv_id", "unit")
        .agg(F.min("turn").alias("origin"))
    )
    agreed = (
        missing.join(origins, ["conv_id", "unit"])
        .where("origin < turn")
        .groupBy(*names, "origin")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*names)
        .agg(F.max(F.struct("n", (-F.col("origin")).alias("back"))).alias("most"))
    )
    all_units = missing.groupBy(*names).agg(F.count(F.lit(1)).alias("n_units"))
    return (
        agreed.join(all_units, names)
        .where(f"{SHARE} * most.n >= n_units")
        .select("conv_id", "key", "turn", "level", (-F.col("most.back")).alias("origin"))
    )


def _threads(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, thread, depth): the first turn of the chain of replies and its length.
    Chains are followed in doubling steps, a stored table each; replies point to earlier turns, so
    the steps end."""
    now = stored(
        links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")),
        "threads",
    )
    for _ in range(most_rounds):
        ahead = now.select(
            "conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"),
            F.col("depth").alias("more"),
        )
        joined = now.join(ahead, ["conv_id", "thread"], "left")
        if joined.where("up is not null").isEmpty():
            return now
        now = stored(
            joined.select(
                "conv_id", "turn", F.coalesce("up", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "threads",
        )
    raise RuntimeError("reply chains did not end")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """A row per message: conv_id, thread, depth, turn, role, reply_to, n_quotes, n_linked, text
    without quotes; sorted by conversation, thread and turn, which puts every reply after what it
    replies to.

    Without a quote that is found, a message begins a thread: thread is its turn, depth 0,
    reply_to null. Null conv_id or turn: the message stays, its quotes aren't linked. Null or
    empty text: empty, no quotes. Repeated rows and turns: each comes back; the turn's links hold
    for all of them. No rows: none. The sort is by ranges of all three columns, so one long
    conversation is spread over tasks."""
    messages = stored(
        parsed(conversations.select("conv_id", "turn", "role", "text")).drop("text"), "messages"
    )
    links = stored(reply_links(messages), "reply-links")
    threads = _threads(links)
    return (
        messages.join(links, ["conv_id", "turn"], "left")
        .join(threads, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            F.coalesce("thread", "turn").alias("thread"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
            "turn",
            "role",
            "reply_to",
            F.size("passages").cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.col("own_text").alias("text"),
        )
        .orderBy("conv_id", "thread", "turn", "role", "text")
    )


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS id
  FROM conversations
), split_up AS (
  SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM lines
), marked AS (
  SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks FROM split_up
), levels AS (
  SELECT *, length(marks) - length(replace(marks, '>', '')) AS level,
         trim(substring(line, length(marks) + 1)) AS words
  FROM marked
), runs AS (
  SELECT *, sum(CASE WHEN words <> '' AND prev = level THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS run
  FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY n) AS prev FROM levels)
), passages AS (
  SELECT id, conv_id, turn, level, run, string_agg(nullif(words, ''), chr(10) ORDER BY n) AS words
  FROM runs GROUP BY ALL HAVING level > 0 AND words IS NOT NULL
), quotes AS (
  SELECT id, conv_id, turn, level, words, md5(trim(regexp_replace(lower(words), '\s+', ' ', 'g'))) AS key FROM passages
), own AS (
  SELECT id, conv_id, turn, role, CASE WHEN regexp_matches(text, '(?m)^[ \t]*>') THEN
    trim(array_to_string([x FOR x IN string_split(text, chr(10)) IF NOT regexp_matches(x, '^(?:[ \t]*>)+')
         AND NOT regexp_matches(x, '(?i)^\s*on .{1,200} wrote:\s*$')], chr(10))) ELSE text END AS text
  FROM lines
), held AS (
  SELECT conv_id, turn, md5(trim(regexp_replace(lower(unit), '\s+', ' ', 'g'))) AS key
  FROM (SELECT conv_id, turn, unnest(list_concat([text], string_split_regex(text, '\n[ \t]*\n'), string_split(text, chr(10)))) AS unit FROM own)
  WHERE regexp_matches(unit, '\S')
), origins AS (
  SELECT conv_id, key, min(turn) AS origin FROM held GROUP BY ALL
), whole AS (
  SELECT DISTINCT q.id, q.conv_id, q.turn, q.level, q.key, o.origin
  FROM quotes q JOIN origins o USING (conv_id, key) WHERE o.origin < q.turn
), trimmed AS (
  SELECT q.conv_id, q.turn, q.level, q.key, string_split(q.words, chr(10)) AS ls,
         regexp_extract_all(lower(q.words), '[\p{L}\p{N}\p{M}]+') AS w
  FROM quotes q ANTI JOIN whole f ON f.conv_id = q.conv_id AND f.turn = q.turn AND f.level = q.level AND f.key = q.key
), units AS (
  SELECT DISTINCT conv_id, turn, level, key, unit FROM (
    SELECT conv_id, turn, level, key, unnest(list_concat(
      [array_to_string(regexp_extract_all(lower(x), '[\p{L}\p{N}\p{M}]+'), ' ') FOR x IN ls],
      CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END)) AS unit
    FROM trimmed) WHERE unit <> ''
), own_cut AS (
  SELECT conv_id, turn, string_split(text, chr(10)) AS ls,
         regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w
  FROM own
), own_units AS (
  SELECT conv_id, turn, unnest(list_concat(
    [array_to_string(regexp_extract_all(lower(x), '[\p{L}\p{N}\p{M}]+'), ' ') FOR x IN ls],
    flatten([[array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)] FOR k IN [1, 2, 3, 4]]))) AS unit
  FROM own_cut
), unit_origins AS (
  SELECT conv_id, unit, min(turn) AS origin FROM own_units WHERE unit <> '' GROUP BY ALL
), agreed AS (
  SELECT u.conv_id, u.turn, u.level, u.key, o.origin, count(*) AS n
  FROM units u JOIN unit_origins o USING (conv_id, unit) WHERE o.origin < u.turn GROUP BY ALL
), best AS (
  SELECT conv_id, turn, level, key, origin, n FROM agreed
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, level, key ORDER BY n DESC, origin) = 1
), sizes AS (
  SELECT conv_id, turn, level, key, count(*) AS n_units FROM units GROUP BY ALL
), found AS (
  SELECT conv_id, turn, level, origin FROM whole
  UNION ALL
  SELECT b.conv_id, b.turn, b.level, b.origin FROM best b JOIN sizes USING (conv_id, turn, level, key)
  WHERE 4 * b.n >= n_units
), links AS (
  SELECT conv_id, turn, arg_max(origin, -level * 1000000000 + origin) AS reply_to, count(*) AS n_linked
  FROM found GROUP BY ALL
), chain AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links
  UNION ALL
  SELECT c.conv_id, c.turn, l.reply_to, c.depth + 1 FROM chain c JOIN links l ON l.conv_id = c.conv_id AND l.turn = c.thread
), threads AS (
  SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM chain GROUP BY ALL
), counted AS (SELECT id, count(*) AS n FROM quotes GROUP BY ALL)
SELECT o.conv_id, coalesce(t.thread, o.turn) AS thread, coalesce(t.depth, 0)::BIGINT AS depth, o.turn, o.role,
       l.reply_to, coalesce(c.n, 0)::BIGINT AS n_quotes, coalesce(l.n_linked, 0)::BIGINT AS n_linked, o.text
FROM own o LEFT JOIN links l USING (conv_id, turn) LEFT JOIN threads t USING (conv_id, turn) LEFT JOIN counted c USING (id)
"""
