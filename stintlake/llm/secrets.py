"""Secret scans: base patterns, and automata inferred from labelled credentials.

For each kind of credential, a prefix tree of labelled examples is folded into a small
probabilistic automaton: states whose next-character and end frequencies agree within the
Hoeffding bound are merged, tree by tree, until none agree. Candidates are all stretches of a run of
token characters that may be a credential of a format: of a length that its labelled examples have,
in their characters, between fitting ends. They are scored by their likelihood under the
format's automaton against a model of ordinary tokens, and the best ones that don't overlap count.
"""

import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from functools import lru_cache, partial
from itertools import accumulate
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.llm.common import table

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of a run of 24 and more, the whole run
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")

#: Runs of token characters. Those shorter than every labelled example hold no candidate.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Inside a run, a credential without a fixed start stands between these, or its format's other
#: characters.
BEGINS = "/="
#: What stands around such a credential must read like ordinary tokens: at least as likely as the
#: middle between this quantile of theirs and random characters. So many say nothing either way.
UNUSUAL, SHORT = 0.01, 3
#: Natural logs per character by which a format must beat ordinary tokens.
LEAST_GAIN = 0.6
#: Strictness of the merge test, and the weight of characters never seen in a state.
ALPHA = 0.05
UNSEEN = 0.02
ALPHABET = string.ascii_letters + string.digits + "+/_=-."
#: Texts of a batch that are redacted at a time.
ROWS = 500


# --- labelled credentials -------------------------------------------------------------------

HEX_DIGITS = "0123456789abcdef"
UPPER_DIGITS = string.ascii_uppercase + "234567"
LETTERS_DIGITS = string.ascii_letters + string.digits
URL_SAFE = LETTERS_DIGITS + "_-"
#: Format: fixed start, alphabet, shortest and longest rest.
FORMATS = {
    "aws_access_key": ("AKIA", UPPER_DIGITS, 16, 16),
    "aws_temporary_key": ("ASIA", UPPER_DIGITS, 16, 16),
    "aws_secret_key": ("", LETTERS_DIGITS + "+/", 40, 40),
    "github_token": ("ghp_", LETTERS_DIGITS, 36, 36),
    "gitlab_token": ("glpat-", URL_SAFE, 20, 20),
    "google_api_key": ("AIza", URL_SAFE, 35, 35),
    "slack_token": ("xoxb-", string.digits + "-" + LETTERS_DIGITS, 40, 56),
    "stripe_key": ("sk_live_", LETTERS_DIGITS, 24, 32),
    "npm_token": ("npm_", LETTERS_DIGITS, 36, 36),
    "json_web_token": ("eyJhbGciOi", URL_SAFE, 40, 120),
    "hex_token": ("", HEX_DIGITS, 32, 64),
}
#: Labelled examples made of each format.
EXAMPLES = 300


def labelled_credentials(seed: int = 11) -> list[tuple[str, str]]:
    """(kind, token) rows: random credentials of public formats, each with its label."""
    pick = random.Random(seed)
    rows = []
    for kind, (start, letters, least, most) in FORMATS.items():
        for _ in range(EXAMPLES):
            rest = "".join(pick.choices(letters, k=pick.randint(least, most)))
            rows.append((kind, start + rest))
    return rows


def ordinary_tokens(seed: int = 12) -> list[str]:
    """Labelled as no credentials: words run together, paths, versions, dates, numbered names; and
    long words, names and paths without digits, rules and numbers."""
    pick = random.Random(seed)
    consonants, vowels = "bcdfghlmnprstvw", "aeiou"

    def word():
        return "".join(
            pick.choice(consonants) + pick.choice(vowels) + pick.choice(["", "n", "r", "st"])
            for _ in range(pick.randint(1, 4))
        )

    def number():
        return str(pick.randint(0, 10 ** pick.randint(1, 4)))

    shapes = [
        lambda: "/".join([word(), word(), word(), number()]),
        lambda: "-".join([word(), word(), number(), word()]),
        lambda: "_".join([word(), number(), word(), word()]),
        lambda: f"{pick.randint(1990, 2030)}-{pick.randint(10, 12)}-{pick.randint(10, 28)}T"
        f"{pick.randint(10, 23)}-{pick.randint(10, 59)}-{pick.randint(10, 59)}",
        lambda: word().title() + word().title() + word().title() + number(),
        lambda: word() + word() + word() + word() + number(),
        lambda: word() + "=" + word() + number() + "/" + word() + "=" + number(),
        lambda: "".join(pick.choices(string.digits, k=pick.randint(16, 24))) + word(),
    ]
    onsets = "b c d f g h j k l m n p qu r s t v w x y z br ch cl cr dr fr gr ph pl pr sch sh sp st str th tr".split()
    middles = "a e i o u a e i o u ai au ea ee ei ie io oo ou y".split()
    codas = ["", "", "", *"b ck ct d ft g ght k l ld ll m mm n nd ng ns nt p r rs rt s ss st t tt".split()]

    def long_word(parts):
        return "".join(pick.choice(x) for _ in range(parts) for x in (onsets, middles, codas))

    def names(mark, change):
        return mark.join(change(long_word(pick.randint(1, 3))) for _ in range(pick.randint(3, 6)))

    plain_shapes = [
        lambda: long_word(pick.randint(5, 9)),
        lambda: long_word(pick.randint(5, 9)).title(),
        lambda: long_word(pick.randint(5, 9)).upper(),
        lambda: names("", str.title),
        lambda: names("_", str.upper),
        lambda: names("_", str.lower),
        lambda: names("-", str.lower),
        lambda: names("/", str.lower),
        lambda: pick.choice("-=_/+") * 16,
        lambda: "".join(pick.choices(string.digits, k=pick.randint(16, 24))),
    ]
    rows = [pick.choice(shapes)() for _ in range(4 * EXAMPLES)]
    return rows + [pick.choice(plain_shapes)() for _ in range(4 * EXAMPLES)]


# --- grammar inference ----------------------------------------------------------------------


class Automaton:
    """A prefix tree of counted tokens whose compatible states are merged."""

    def __init__(self, tokens: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # of each next character; "" is the end
        for token in tokens:
            at = 0
            for c in token:
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                at = self.next[at][c]
            self.count[at][""] += 1
        self.total = [sum(c.values()) for c in self.count]
        self.bound = math.sqrt(math.log(2 / alpha) / 2)
        self._merge_states()
        self._score()

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _agree(self, a: int, b: int) -> bool:
        """Whether the states, and all that follows both, have frequencies that agree."""
        open_pairs, seen = [(a, b)], set()
        while open_pairs:
            a, b = open_pairs.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self.total[a], self.total[b]
            if self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) >= 1:
                continue  # too few tokens to tell them apart, or what follows them
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    open_pairs.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the subtree under b to a. b is still a tree, so every state is folded once."""
        open_pairs = [(a, b)]
        while open_pairs:
            a, b = open_pairs.pop()
            self.count[a].update(self.count[b])
            self.total[a] += self.total[b]
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    open_pairs.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_states(self) -> None:
        """Kept states meet each state that follows one of them: merged with the first kept state
        that agrees, or else kept. States with most tokens come first."""
        kept = [0]
        while True:
            inside = set(kept)
            fringe = {
                child: (a, c) for a in kept for c, child in self.next[a].items()
                if child not in inside
            }
            if not fringe:
                break
            b = max(fringe, key=lambda s: (self.total[s], -s))
            a, c = fringe[b]
            same = next((k for k in kept if self._agree(k, b)), None)
            if same is None:
                kept.append(b)
            else:
                self.next[a][c] = same
                self._fold(same, b)
        self.states = kept

    def _score(self) -> None:
        """Logs of the probabilities, with a little left for what was never seen. Only the kept
        states stay: a trained automaton is small."""
        self.rare = math.log(UNSEEN / len(ALPHABET))
        self.log = {
            s: {
                c: math.log((1 - UNSEEN) * k / self.total[s] + UNSEEN / len(ALPHABET))
                for c, k in self.count[s].items()
            }
            for s in self.states
        }
        self.next = {s: self.next[s] for s in self.states}
        del self.count, self.total

    def per_char(self, token: str) -> float:
        """Mean log likelihood of a character. A character that a state can't take costs the
        unseen weight and leaves the state as it is."""
        at, total = 0, 0.0
        for c in token:
            total += self.log[at].get(c, self.rare)
            at = self.next[at].get(c, at)
        return total / len(token)


def pair_model(tokens: list[str]) -> dict:
    """Logs of character pairs in ordinary tokens."""
    pairs, firsts = Counter(), Counter()
    for token in tokens:
        for a, b in zip("^" + token, token, strict=False):
            pairs[a, b] += 1
            firsts[a] += 1
    n = len(ALPHABET)
    return {
        (a, b): math.log((pairs[a, b] + 0.5) / (firsts[a] + 0.5 * n))
        for a in "^" + ALPHABET
        for b in ALPHABET
    }


class Scanner:
    """Automata by kind, trained on labelled credentials and ordinary tokens."""

    def __init__(self, credentials: list[tuple[str, str]], ordinary: list[str]):
        by_kind: dict[str, list[str]] = {}
        for kind, token in sorted(credentials):
            by_kind.setdefault(kind, []).append(token)
        self.formats = {kind: Automaton(tokens) for kind, tokens in by_kind.items()}
        self.ordinary = pair_model(ordinary)
        self.begin = {kind: commonprefix(tokens) for kind, tokens in by_kind.items()}
        self.letters = {kind: frozenset("".join(tokens)) for kind, tokens in by_kind.items()}
        lengths = {kind: sorted(map(len, tokens)) for kind, tokens in by_kind.items()}
        self.least = {kind: known[0] for kind, known in lengths.items()}
        #: Formats whose examples are all equally long have that length; others may be longer.
        self.fixed_length = {kind: known[0] == known[-1] for kind, known in lengths.items()}
        self.shortest = min(self.least.values())
        usual = sorted(sum(self._plain(t)) / len(t) for t in ordinary if len(t) > SHORT)
        blind = [self.ordinary[a, b] for a in LETTERS_DIGITS for b in LETTERS_DIGITS]
        self.usual = (usual[int(UNUSUAL * len(usual))] + sum(blind) / len(blind)) / 2

    def _plain(self, run: str) -> list[float]:
        """Log likelihoods of the characters as an ordinary token."""
        return [self.ordinary[a, b] for a, b in zip("^" + run, run, strict=False)]

    def kind_of(self, token: str) -> str | None:
        """The most likely format, where it beats ordinary tokens clearly; ties: first by name."""
        plain = sum(
            self.ordinary[a, b] for a, b in zip("^" + token, token, strict=False)
        ) / len(token)
        best, kind = max(
            ((a.per_char(token), k) for k, a in self.formats.items()), key=lambda x: x[0]
        )
        return kind if best - plain >= LEAST_GAIN else None

    def _begins(self, kind: str, run: str, reads) -> list[int]:
        """Where a credential of a format may begin: at its fixed start behind no letter or digit;
        without one, at the run's start or behind a character that ends ordinary tokens there."""
        fixed, letters = self.begin[kind], self.letters[kind]
        if not fixed:
            return [0] + [
                i for i in range(1, len(run))
                if (run[i - 1] in BEGINS or run[i - 1] not in letters) and run[i] in letters and reads(0, i - 1)
            ]
        found, i = [], run.find(fixed)
        while i >= 0:
            if not i or not run[i - 1].isalnum():
                found.append(i)
            i = run.find(fixed, i + 1)
        return found

    def _ends(self, kind: str, run: str, start: int, reads, gains) -> list[tuple[float, int]]:
        """(gain, end) of the candidates from a place, at most one with a fixed start: there, the
        end of greatest gain, moved to its word's, or of all that fits if a few characters are left."""
        letters, least = self.letters[kind], self.least[kind]
        model, at, total, totals = self.formats[kind], 0, 0.0, []
        longest = start + least if self.fixed_length[kind] else len(run)
        for i in range(start, min(longest, len(run))):
            c = run[i]
            if c not in letters:
                break
            total += model.log[at].get(c, model.rare) - gains[i]
            totals.append(total)
            at = model.next[at].get(c, at)
        if len(totals) < least:
            return []
        if self.begin[kind]:
            n = max(range(least, len(totals) + 1), key=lambda n: totals[n - 1])
            while n < len(totals) and run[start + n].isalnum():  # the end of the word it is in
                n += 1
            n = len(totals) if len(totals) - n <= SHORT else n
            return [(totals[n - 1], start + n)]
        return [
            (totals[n - 1], start + n) for n in range(least, len(totals) + 1)
            if start + n == len(run)
            or (run[start + n] in BEGINS or run[start + n] not in letters) and reads(start + n + 1, len(run))
        ]

    def stretches(self, run: str) -> list:
        """(start, end, kind) of the parts of a run that a format explains better than ordinary tokens
        by the least gain a character: greatest gain first, without overlaps."""
        if len(run) < self.shortest:
            return []
        plain = self._plain(run)
        sums = [0.0, *accumulate(plain)]

        def reads(start: int, end: int) -> bool:
            """Whether a part of the run reads like ordinary tokens."""
            return end - start <= SHORT or sums[end] - sums[start] >= self.usual * (end - start)

        gains = [x + LEAST_GAIN for x in plain]
        found = []
        for kind in self.formats:
            for start in self._begins(kind, run, reads):
                found += [(gain, start, end, kind) for gain, end in self._ends(kind, run, start, reads, gains) if gain >= 0]
        kept, used = [], bytearray(len(run))
        for _, start, end, kind in sorted(found, key=lambda x: (-x[0], x[1:])):
            if not any(used[start:end]):
                used[start:end] = b"\1" * (end - start)
                kept.append((start, end, kind))
        return kept

    def _inferred(self, text: str, base: list) -> list:
        """Spans of inferred kinds beside the base spans. Where base spans cut a run, what they
        leave is scored by itself, and a credential found in the whole run gives its rest."""
        taken: list[list[int]] = []
        for start, end in sorted((s, e) for s, _, _, e in base):
            if taken and start <= taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], end)
            else:
                taken.append([start, end])
        ends = [e for _, e in taken]
        found = []
        for m in CANDIDATE.finditer(text):
            low, high = m.span()
            if high - low < self.shortest:
                continue
            free, at, cut = [], low, False
            for start, end in taken[bisect_right(ends, low):]:
                if start >= high:
                    break
                cut = True
                free.append((at, start))
                at = end
            free = [(a, b) for a, b in [*free, (at, high)] if a < b]
            if not cut:
                found += [(low + s, 3, k, low + e) for s, e, k in self.stretches(m.group())]
                continue
            whole = [(low + s, low + e, k) for s, e, k in self.stretches(m.group())] if free else []
            for a, b in free:
                own = self.stretches(text[a:b])
                own = [(a + s, a + e, k) for s, e, k in own]
                rest = [(max(a, s), min(b, e), k) for s, e, k in whole if s < b and a < e]
                own = [x for x in own if not any(s <= x[0] and x[1] <= e for s, e, _ in rest)] + rest
                found += [(s, 3, k, e) for s, e, k in own]
        return found

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans and all spans as (start, kind order, kind, end), each list in order."""
        base = []
        low = text.lower()
        if any(word in low for word in ASSIGN_WORDS):
            base += [
                (m.start(), 0, "assign", m.end())
                for m in ASSIGN.finditer(text)
                if len(m.group(2)) >= ASSIGN_LEAST
            ]
        if "AKIA" in text:
            base += [
                (m.start(), 1, "access", m.end())
                for m in ACCESS.finditer(text)
                if len(m.group()) >= ACCESS_LEAST
            ]
        base += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
        base.sort()
        every = base + self._inferred(text, base)
        every.sort()
        return base, every


@lru_cache(maxsize=4)
def default_scanner(seed: int = 11) -> Scanner:
    """Trained on the driver; a few states a kind, so it travels with the tasks."""
    return Scanner(labelled_credentials(seed), ordinary_tokens(seed + 1))


def _written(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def redact(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    parts, done = [], 0
    for start, _, kind, end in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _scanned(batches, scanner):
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base, every = scanner.spans(text)
            kinds = Counter(kind for _, _, kind, _ in base)
            digest = hashlib.sha256(_written(base).encode()).hexdigest()
            rows.append((*[kinds[k] for k in BASE_KINDS], digest, _written(every)))
        n_assign, n_access, n_hex, digests, spans = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(n_assign, pa.int64()),
                pa.array(n_access, pa.int64()), pa.array(n_hex, pa.int64()),
                pa.array(digests, pa.string()), pa.array(spans, pa.string()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """A row per document: counts of the base kinds, a digest of the base spans, all spans as
    kind:start:end in code points.

    Null or empty text: no spans, the digest of no text. Equal starts: assign, access, hex, then
    inferred kinds. An inferred span never overlaps a base one. Repeated rows: alike."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        partial(_scanned, scanner=scanner or default_scanner()),
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "spans string",
    )


def _redacted(batches, scanner):
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):  # a few texts at a time as Python strings
            batch, texts = whole.slice(i, ROWS), []
            for value in batch.column("text"):
                text = value.as_py()
                spans = scanner.spans(text)[1] if text else []
                texts.append(redact(text, spans) if spans else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redacted_documents(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """All documents with every secret replaced by its kind; n_chars follows the text."""
    own = docs.columns
    return (
        docs.select(*own)
        .mapInArrow(partial(_redacted, scanner=scanner or default_scanner()), docs.schema)
        .withColumn(
            "n_chars",
            F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")),
        )
        .select(*own)
    )


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
