"""Quotation linking on made conversations that hold nested, whole, trimmed and short quotes."""

import random

import duckdb
from test_rows import TRIMMED, compared

from stintlake.llm import chat

KIND = "conv_id long, turn long, role string, text string"


def made_conversations(seed, count):
    """Rows, and by (conv_id, turn) the turn that each quoting message quotes."""
    pick, rows, real = random.Random(seed), [], {}
    letters = "abcdefghiklmnoprstuvwé"

    def words(n):
        return ["".join(pick.choices(letters, k=pick.randint(4, 9))) for _ in range(n)]

    def trimmed(text, kind):
        lines = text.split("\n")
        of = text.replace("\n", " ").split(" ")
        at = pick.randrange(max(1, len(of) - 6))
        if kind == "whole":
            return text
        if kind == "lines":
            return "\n".join(lines[: max(1, len(lines) - 1)])
        if kind == "run":
            return " ".join(of[at : at + 6])
        if kind == "short":
            return " ".join(of[at : at + pick.randint(1, 3)]).rstrip(".,")
        if kind == "elided":
            return " ".join([*of[:6], "[...]", *of[-6:]])
        return pick.choice(lines).upper()

    for conv in range(count):
        held = []
        for turn in range(pick.randint(2, 9)):
            body = "\n".join(" ".join(words(pick.randint(5, 14))).capitalize() + "." for _ in range(pick.randint(1, 4)))
            text = body
            if held and pick.random() < 0.7:
                origin = pick.randrange(len(held))
                quote = trimmed(held[origin], pick.choice(["whole", "lines", "run", "short", "elided", "line"]))
                marked = "\n".join("> " + x for x in quote.split("\n"))
                if pick.random() < 0.3 and origin:
                    inner = trimmed(held[origin - 1], pick.choice(["run", "short"]))
                    marked = f">> {inner}\n{marked}"
                text = f"{marked}\n{body}"
                real[conv, turn] = origin
            rows.append((conv, turn, pick.choice(["user", "assistant"]), text))
            held.append(body)
    return rows, real


def test_made_quotes_are_found_and_equal_the_sql(spark):
    rows, real = made_conversations(11, 120)
    strangers = [(10_000 + i, t, "user", x) for i, (_, t, _, x) in enumerate(rows) if x.startswith(">")]
    df = spark.createDataFrame(rows + strangers + [(c + 20_000, t, "u", x) for c, t, x in TRIMMED], KIND)
    connection = duckdb.connect()
    connection.register("conversations", df.toArrow())
    names = sorted(df.columns + ["thread", "depth", "reply_to", "n_quotes", "n_linked"])
    found = [dict(zip(names, r, strict=True)) for r in compared(chat.reply_ordered(df), connection, chat.OP10_SQL)]
    links = {(r["conv_id"], r["turn"]): r["reply_to"] for r in found if r["reply_to"] is not None and r["conv_id"] < 20_000}
    right = sum(links.get(k) == v for k, v in real.items())
    assert len(real) > 300 and right >= 0.9 * len(real)
    assert right >= 0.95 * len(links)  # what is linked is linked to what was quoted
    assert not any(conv >= 10_000 for conv, _ in links)
    assert not any(line.startswith(">") for r in found for line in (r["text"] or "").split("\n"))


def test_short_quotes_without_their_punctuation(spark):
    rows = [(1, 0, "u", "Yes, do it."), (1, 1, "u", "> do it\nno"), (1, 2, "u", "See the plan of Tuesday."),
            (1, 3, "u", "> plan of Tuesday\nwell"), (1, 4, "u", "> never said\n> ...\nwhat"), (1, 5, "u", "> !?\nhm")]
    found = chat.reply_ordered(spark.createDataFrame(rows, KIND)).collect()
    assert {r["turn"]: r["reply_to"] for r in found} == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: None}


def test_very_many_quoted_lines(spark):
    lines = [f"line number {i} of it" for i in range(8000)]
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "u", "\n".join(f"{'>' * (1 + i % 2)} {x}" for i, x in enumerate(lines)))]
    found = {r["turn"]: r for r in chat.reply_ordered(spark.createDataFrame(rows, KIND)).collect()}
    assert found[1]["reply_to"] == 0 and found[1]["n_quotes"] == 8000 == found[1]["n_linked"] and found[1]["text"] == ""
