"""Conversation structure: faults, the cheapest repair, and the repaired turns.

Each turn becomes a symbol of its role (system, user, assistant, other, by the
first letter) and its fault (none, truncated, blank, duplicate). Re-Pair builds
one grammar for all conversations: rounds count the adjacent pairs of all
symbol sequences in Spark and give the most frequent ones a symbol. A rule has
one min-plus transfer matrix over the states of the allowed order of roles
``(s?(ua)+)?``: the least cost of leading from state to state, and the edits as
a rope. The matrix of a rule is the product of the two it stands for, made once
in a task and shared by all conversations. Edits are written as letters: Keep,
Rerole, Delete, Insert; among equally cheap ones the least in ASCII order counts.

Matrices need no comparison of texts: within a row of a matrix the edits that
lead to different states differ before either ends, as each holds one letter
other than I per turn and ends with one. So a rank per entry orders ropes, also
when they are joined, and ropes are only spelt out at the end.

Long conversations are cut into parts of ``part`` turns by a range partitioning
of all turns, so one conversation may fill many tasks; parts are evaluated on
their own and joined in order. Equal turns are counted before anything is dealt
by conversation. Writing the repaired turns goes through each conversation in
order, holding its edits and no texts.

NULL roles and texts count as one space, NULL turn numbers come first, and turns
of one number stand in the order of role and of the SHA-256 of their text.
Conversations may have a NULL key. Rows that are not present only name their
conversation; one without a turn has zeros and no edits. Very long texts are
read by the JVM alone until the turns are written. Extra columns, whatever their
names, are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.columns import named
from varve.llm.common import materialise
from varve.session import ship

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Turns of a part, rounds of pairing, and pairs that become rules in a round.
PART, ROUNDS, PAIRS = 4096, 6, 16

# States: before anything, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
TURNED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}

FAULTS, INITIALS = ("none", "truncated", "blank", "duplicate"), "suax"
# Symbols of turns are letters from A on, so that a part is a string; those of rules start further up.
SYMBOLS = [chr(65 + i) for i in range(16)]
FIRST_RULE = 256
_TO_INITIAL = str.maketrans({s: INITIALS[i % 4] for i, s in enumerate(SYMBOLS)})
_TO_FAULT = str.maketrans({s: str(i // 4) for i, s in enumerate(SYMBOLS)})


class Entry(NamedTuple):
    cost: int
    rank: int
    rope: object  # a string, or a pair of ropes


def spelt(rope) -> str:
    """The letters of a rope."""
    out, stack = [], [rope]
    while stack:
        r = stack.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            stack += (r[1], r[0])
    return "".join(out)


def _ranked(row: list) -> tuple:
    """Entries (cost, order, rope) or None with ranks in place of the order."""
    orders = sorted(e[1] for e in row if e)
    return tuple(e and Entry(e[0], orders.index(e[1]), e[2]) for e in row)


def turn_matrix(symbol: int) -> tuple:
    """Transfer matrix of one turn: inserts before it, then its own edit."""
    fault, initial = FAULTS[symbol // 4], INITIALS[symbol % 4]
    extra = TRUNCATED if fault == "truncated" else 0
    rows = []
    for i in range(4):
        best: list = [None] * 4
        state, inserts = i, 0
        while inserts < 3:
            moves = [(state, DELETE, "D")]
            if fault in ("none", "truncated"):
                moves.append((TURNED[state], REROLE + extra, "R"))
                if state in KEPT[initial]:
                    moves.append((KEPT[initial][state], extra, "K"))
            for to, cost, edit in moves:
                text = "I" * inserts + edit
                entry = (inserts * INSERT + cost, text, text)
                if best[to] is None or entry < best[to]:
                    best[to] = entry
            state, inserts = TURNED[state], inserts + 1
        rows.append(_ranked(best))
    return tuple(rows)


def _row_times(row, matrix) -> tuple:
    best: list = [None] * 4
    for k, left in enumerate(row):
        if left is None:
            continue
        for j, right in enumerate(matrix[k]):
            if right is not None:
                entry = (left.cost + right.cost, (left.rank, right.rank))
                if best[j] is None or entry < best[j][:2]:
                    best[j] = (*entry, (left.rope, right.rope))
    return _ranked(best)


def product(a, b) -> tuple:
    """Min-plus product of two transfer matrices."""
    return tuple(_row_times(row, b) for row in a)


class Grammar:
    """Rules ``(left, right)``, whose symbols count up from FIRST_RULE, and a matrix for each symbol."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.pairs = [(a + b, chr(FIRST_RULE + i)) for i, (a, b) in enumerate(rules)]
        self.matrix = {s: turn_matrix(i) for i, s in enumerate(SYMBOLS)}
        for (a, b), (_, symbol) in zip(rules, self.pairs):
            self.matrix[symbol] = product(self.matrix[a], self.matrix[b])

    def compressed(self, symbols: str) -> str:
        for pair, symbol in self.pairs:
            symbols = symbols.replace(pair, symbol)
        return symbols

    def evaluated(self, symbols: str) -> tuple:
        """The matrix of a sequence of one turn or more."""
        short = self.compressed(symbols)
        found = self.matrix[short[0]]
        for s in short[1:]:
            found = product(found, self.matrix[s])
        return found


def _symbol(fault: Column, initial: Column) -> Column:
    return F.substring(F.lit("".join(SYMBOLS)), fault * 4 + initial + 1, F.lit(1))


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct turns without their texts: key, turn, role, digest, the symbols of the first and of further ones, and n."""
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    turns = materialise(rows.select(
        "key", F.when(F.col("present"), F.col("turn")).alias("turn"),
        F.when(F.col("present"), F.col("role")).otherwise("").alias("role"),
        F.when(F.col("present"), F.col("digest")).otherwise("").alias("digest"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"), F.col("present").cast("long").alias("present"),
    ).groupBy("key", "turn", "role", "digest").agg(
        F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.sum("present").alias("n"),
    ))
    # The first place of what is said at several turns; written, so that a frequent one can be split in the join.
    again = materialise(
        turns.where("n > 0").groupBy("key", "role", "digest")
        .agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("turn")).alias("first")).where("places > 1")
        .select(F.col("key").alias("k"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    )
    on = F.col("key").eqNullSafe(F.col("k")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    said = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    number = lambda fault: F.lit(FAULTS.index(fault))
    first = F.when(F.col("blank"), number("blank")).when(said, number("duplicate")).when(F.col("cut"), number("truncated"))
    return turns.join(again, on, "left").select(
        "key", "turn", "role", "digest", _symbol(first.otherwise(number("none")), initial).alias("first"),
        _symbol(F.when(F.col("blank"), number("blank")).otherwise(number("duplicate")), initial).alias("rest"), "n",
    )


def _cut(size: int):
    """Sorted turns to parts: start (turn, role, digest, piece), symbols, and lowest, highest and number of turn numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "turn", "role", "digest", "piece", "symbols", "lowest", "highest", "numbers"]
        made: list[list] = []
        part: list | None = None
        symbols: list[str] = []
        held = 0
        schema = None

        def close():
            nonlocal held
            if part is not None:
                part[5] = "".join(symbols)
                made.append(part)
            symbols.clear()
            held = 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows))], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    ("key", batch.schema.field("key").type), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()),
                    ("piece", pa.int64()), ("symbols", pa.string()), ("lowest", pa.int64()), ("highest", pa.int64()),
                    ("numbers", pa.int64()),
                ])
            for key, turn, role, digest, first, rest, n in zip(*(batch.column(c).to_pylist() for c in (
                "key", "turn", "role", "digest", "first", "rest", "n"
            ))):
                left, symbol = n, first
                while True:
                    if part is None or part[0] != key or held >= size:
                        piece = part[4] + 1 if part is not None and part[0] == key else 0
                        close()
                        part = [key, turn, role, digest, piece, "", None, None, 0]
                    if turn is not None:
                        part[8] += part[7] != turn
                        part[6] = turn if part[6] is None else part[6]
                        part[7] = turn
                    if not left:
                        break
                    take = 1 if symbol == first and left == n else min(left, size - held)
                    symbols.append(symbol * take)
                    held, left, symbol = held + take, left - take, rest
                    if not left:
                        break
                if len(made) >= 1000:
                    yield batch_of(made)
                    made.clear()
        close()
        if made:
            yield batch_of(made)

    return cut


def _pair_counts(rules: list[tuple[str, str]]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, seen = Grammar(rules), Counter()
        for batch in batches:
            for symbols, times in zip(batch.column("symbols").to_pylist(), batch.column("times").to_pylist()):
                short = grammar.compressed(symbols)
                for pair, n in Counter(map("".join, zip(short, short[1:]))).items():
                    # Pairs of equal symbols overlap in a longer repeat, of which every other one counts.
                    seen[pair] += times * (n if pair[0] != pair[1] else short.count(pair))
        yield pa.RecordBatch.from_arrays([
            pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())
        ], names=["pair", "times"])

    return count


def learn_grammar(parts: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[tuple[str, str]]:
    """Rules of Re-Pair over the column ``symbols``: at most ``rounds`` times ``pairs``, from counts over all rows.

    A round takes the most frequent pairs whose places cannot overlap, so that
    one reading of the sequences serves several rules.
    """
    shapes = materialise(parts.where("symbols <> ''").groupBy("symbols").agg(F.count(F.lit(1)).alias("times")))
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        counts = shapes.mapInArrow(_pair_counts(rules), "pair string, times long")
        # Pairs are bounded by the squared number of symbols; the leading ones come to the driver.
        leading = counts.groupBy("pair").agg(F.sum("times").alias("times")).where("times > 1")
        firsts, seconds, size = set(), set(), len(rules)
        for row in leading.orderBy(F.desc("times"), "pair").limit(16 * pairs).collect():
            a, b = row["pair"]
            if b not in firsts and a not in seconds and len(rules) - size < pairs:
                rules.append((a, b))
                firsts.add(a)
                seconds.add(b)
        if len(rules) == size:
            break
    return rules


def _evaluated(rules: list[tuple[str, str]]):
    """Parts to their counts and the costs and edits of their matrix, row by row."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, known = Grammar(rules), {}
        for batch in batches:
            rows = []
            for symbols in batch.column("symbols").to_pylist():
                if symbols not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[symbols] = _described(grammar, symbols)
                rows.append(known[symbols])
            kept = [f for f in batch.schema if f.name != "symbols"]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(f.name) for f in kept],
                *[pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)],
            ] if rows else [pa.array([], f.type) for f in [*kept, *_SUMMARY]], schema=pa.schema([*kept, *_SUMMARY]))

    return evaluate


_SUMMARY = pa.schema([
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("ends", pa.string()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())),
])
SUMMARY = "blank long, duplicate long, truncated long, illegal long, ends string, costs array<bigint>, edits array<string>"


def _illegal(initials: str) -> int:
    return max(0, len(initials) - 1) - sum(map(initials.count, ("su", "ua", "au")))


def _described(grammar: Grammar, symbols: str) -> tuple:
    if not symbols:
        return 0, 0, 0, 0, "", [], []
    initials, faults = symbols.translate(_TO_INITIAL), symbols.translate(_TO_FAULT)
    entries = [e for row in grammar.evaluated(symbols) for e in row]
    return (
        faults.count("2"), faults.count("3"), faults.count("1"), _illegal(initials), initials[0] + initials[-1],
        [e.cost if e else None for e in entries], [spelt(e.rope) if e else None for e in entries],
    )


class _Joined:
    """One conversation, part by part in order."""

    def __init__(self, key):
        self.key, self.last, self.lowest, self.highest = key, "", None, None
        self.counts, self.numbers, self.row = [0, 0, 0, 0], 0, (Entry(0, 0, ""), None, None, None)

    def add(self, blank, duplicate, truncated, illegal, ends, costs, edits, lowest, highest, numbers) -> None:
        illegal += _illegal(self.last + ends[:1]) if self.last else 0
        self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated, illegal))]
        if lowest is not None:
            self.numbers += numbers - (lowest == self.highest)
            self.lowest = lowest if self.lowest is None else self.lowest
            self.highest = highest
        if ends:
            self.last = ends[1]
            rows = [[None if c is None else (c, e, e) for c, e in zip(costs[i:i + 4], edits[i:i + 4])] for i in range(0, 16, 4)]
            self.row = _row_times(self.row, tuple(map(_ranked, rows)))

    def report(self) -> tuple:
        gaps = min((1 << 63) - 1, self.highest - self.lowest + 1 - self.numbers) if self.numbers else 0
        ended = [(e.cost + INSERT * len(FINAL[j]), e.rank, e.rope, FINAL[j]) for j, e in enumerate(self.row) if e]
        cost, _, rope, final = min(ended, key=lambda e: e[:2])
        return (self.key, gaps, *self.counts, cost, spelt(rope) + final)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts to one row per conversation."""
    now, made, schema = None, [], None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([
            ("key", batch.schema.field("key").type), *[(n, pa.int64()) for n in REPORT], ("audit", pa.string())
        ])
        columns = [batch.column(c).to_pylist() for c in ("key", *_SUMMARY.names, "lowest", "highest", "numbers")]
        for key, *rest in zip(*columns):
            if now is None or now.key != key:
                if now is not None:
                    made.append(now.report())
                now = _Joined(key)
            now.add(*rest)
        if made:
            yield batch_of(made)
            made = []
    if now is not None:
        yield batch_of([now.report()])


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of a conversation, then its turns in order, to the repaired turns."""
    key, edits, at, state, place, schema = None, "", 0, START, 0, None
    out: list[tuple] = []

    def insert():
        nonlocal at, state, place
        while at < len(edits) and edits[at] == "I":
            state = TURNED[state]
            out.append((key, place, "I", ROLE[state], ""))
            at, place = at + 1, place + 1

    for batch in batches:
        schema = schema or pa.schema([
            ("key", batch.schema.field("key").type), ("place", pa.int64()), ("edit", pa.string()),
            ("role", pa.string()), ("text", pa.string()),
        ])
        for now, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "role", "text"))):
            if audit is not None:
                insert()
                key, edits, at, state, place = now, audit, 0, START, 0
                continue
            insert()
            edit = edits[at]
            at += 1
            if edit == "D":
                continue
            state = TURNED[state] if edit == "R" else KEPT[role[0]][state]
            out.append((key, place, edit, ROLE[state] if edit == "R" else role, text))
            place += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    insert()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


class Repair(NamedTuple):
    """``reports``: key, gaps, faults, cost and audit per conversation. ``turns``: key, place, edit, role and text of
    each repaired turn; those of a conversation follow each other in order inside a partition."""

    reports: DataFrame
    turns: DataFrame


def repair(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: Column | None = None, part: int = PART,
) -> Repair:
    """Find the faults of conversations and repair them at the least cost.

    The first fault of a turn counts: blank; duplicate (role and text were said
    before); truncated (the last letter ends no sentence). Keeping a turn costs
    0, another role (user or assistant) 1, leaving it out 2, which blank and
    duplicate ones need, and an empty new turn of user or assistant 5; a
    truncated turn that stays costs 5 more. ``illegal`` counts neighbours other
    than system-user, user-assistant and assistant-user, ``gaps`` the turn
    numbers that are missing between the first and the last.
    """
    ship(turns.sparkSession)
    rows = turns.select(
        named(key).alias("key"), named(turn).cast("long").alias("turn"),
        F.coalesce(named(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(named(text).cast("string"), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    ).withColumn("digest", F.sha2("text", 256))
    kind = rows.schema["key"].dataType.simpleString()
    order = ["key", "turn", "role", "digest"]
    placed = materialise(_marked(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    start = f"key {kind}, turn long, role string, digest string, piece long"
    numbers = "lowest long, highest long, numbers long"
    parts = materialise(placed.mapInArrow(_cut(part), f"{start}, symbols string, {numbers}"))
    rules = learn_grammar(parts)
    summed = parts.mapInArrow(_evaluated(rules), f"{start}, {numbers}, {SUMMARY}")
    in_order = summed.repartition("key").sortWithinPartitions(*order, "piece")
    reports = materialise(in_order.mapInArrow(
        _reported, f"key {kind}, " + ", ".join(f"{n} long" for n in REPORT) + ", audit string"
    ))
    none = lambda t: F.lit(None).cast(t)
    heads = reports.select(
        "key", F.lit(0).alias("kind"), "audit", none("long").alias("turn"), none("string").alias("role"),
        none("string").alias("digest"), none("string").alias("text"),
    )
    bodies = rows.where("present").select(
        "key", F.lit(1).alias("kind"), none("string").alias("audit"), "turn", "role", "digest", "text"
    )
    stream = heads.unionByName(bodies).repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "digest")
    out = T.StructType([
        rows.schema["key"], T.StructField("place", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")],
    ])
    repaired = stream.select("key", "audit", "role", "text").mapInArrow(_edited, out)
    return Repair(reports.withColumnRenamed("key", key), repaired.withColumnRenamed("key", key))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, schema, out = None, None, None, []
    for batch in batches:
        schema = schema or pa.schema([("key", batch.schema.field("key").type), ("sha256", pa.string())])
        columns = (batch.column(c).to_pylist() for c in ("key", "place", "role", "text"))
        for now, place, role, text in zip(*columns):
            if place == 0:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], schema[0].type), pa.array([state.hexdigest()])], schema=schema)


def digests(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, sha256) of ``role:text`` joined by line ends, for the turns that ``repair`` gives; none if there are none.

    Takes the turns as they come from ``repair``, in order; texts are hashed one after the other and not gathered.
    """
    rows = turns.select(named(key).alias("key"), "place", "role", "text")
    out = T.StructType([rows.schema["key"], T.StructField("sha256", T.StringType())])
    return rows.mapInArrow(_hashed, out).withColumnRenamed("key", key)
