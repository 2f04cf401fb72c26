"""Conversation structure repair: cheapest edits to well-formed turns, by Four-Russians tables over blocks of rows."""

from __future__ import annotations

from functools import cache
from hashlib import sha256
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.llm.common import lean, stored

#: What a row is to the repair: a first fault of its own, or sound, with the initial of its role (o: any other).
#: b blank, d duplicate; s, u, a, o sound; S, U, A, O truncated.
SYMBOLS = "suaoSUAOx"
DOUBLE = {"b": "x", "d": "x"}
#: States of the text so far: nothing, one system turn, a user turn last, an assistant turn last. Two are whole.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
WHOLE = (NOTHING, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block whose transitions are tabled; rows of a segment that one task traces.
BLOCK, SEGMENT_BITS = 3, 8
FAR, BATCH_ROWS = 1 << 40, 2000


def turn_after(state: int) -> int:
    """The state after a turn of user or assistant that may follow."""
    return ASSISTANT if state == USER else USER


def kept_after(state: int, symbol: str) -> int | None:
    """The state after a row that keeps its role, if it may stand there."""
    role = symbol.lower()
    if role == "s":
        return SYSTEM if state == NOTHING else None
    if role in "ua":
        after = turn_after(state)
        return after if after == (USER if role == "u" else ASSISTANT) else None
    return None


def row_edits(state: int, symbol: str) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of a row in ASCII order of their initials; inserts aside."""
    found = [("D", DELETE, state)]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        after = kept_after(state, symbol)
        if after is not None:
            found.append(("K", more, after))
        found.append(("R", REROLE + more, turn_after(state)))
    return found


def with_inserts(ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest costs from each state if turns may be inserted before what `ahead` costs."""
    best = list(ahead)
    for _ in range(2):  # two inserts in a row lead anywhere that inserts lead
        for state in range(4):
            best[state] = min(best[state], INSERT + best[turn_after(state)])
    return tuple(min(FAR, x) for x in best)


def before(symbol: str, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each state before a row, out of those after it: its edits, and inserts before it."""
    return with_inserts(tuple(min(cost + ahead[to] for _, cost, to in row_edits(state, symbol)) for state in range(4)))


def normal(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector less its least cost, and that cost; what can't be reached stays so."""
    least = min(vector)
    return tuple(FAR if x >= FAR else x - least for x in vector), least


END = with_inserts(tuple(0 if s in WHOLE else FAR for s in range(4)))
UNITS = tuple(with_inserts(tuple(0 if s == t else FAR for s in range(4))) for t in range(4))


@cache
def tables() -> tuple[dict[tuple[int, ...], int], list[tuple[int, ...]], dict[str, list[tuple[int, int]]]]:
    """Numbers of all normalised cost vectors that can arise, the vectors, and for each block of symbols (up to BLOCK of
    them) the transition of each vector: the number of the one before the block, and the cost that is taken off.

    Differences within a vector are bounded, so that there are few; they are found from the ends by all symbols.
    """
    known: dict[tuple[int, ...], int] = {}
    vectors: list[tuple[int, ...]] = []
    for v in (END, *UNITS):
        v = normal(v)[0]
        if v not in known:
            known[v] = len(vectors)
            vectors.append(v)
    single: dict[str, list[tuple[int, int]]] = {s: [] for s in SYMBOLS}
    at = 0
    while at < len(vectors):
        for s in SYMBOLS:
            v, off = normal(before(s, vectors[at]))
            if v not in known:
                known[v] = len(vectors)
                vectors.append(v)
            single[s].append((known[v], off))
        at += 1
    blocks = dict(single)
    for length in range(2, BLOCK + 1):
        for block in map("".join, product(SYMBOLS, repeat=length)):
            rest, first = blocks[block[1:]], single[block[0]]
            blocks[block] = [(first[v][0], off + first[v][1]) for v, off in rest]
    return known, vectors, blocks


def starts_of_blocks(symbols: str, number: int) -> list[tuple[int, int]]:
    """(vector's number, cost taken off since the end) before each block of symbols and at their end, looked up from the end on."""
    blocks = tables()[2]
    off, found = 0, [(number, 0)]
    for at in range((len(symbols) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        number, more = blocks[symbols[at : at + BLOCK]][number]
        off += more
        found.append((number, off))
    return found[::-1]


def through(symbols: str) -> list[int]:
    """The 4 x 4 costs of a segment from each state before it to each after it, row by row; FAR where none leads."""
    known, vectors, _ = tables()
    columns = []
    for unit in UNITS:
        v, least = normal(unit)
        number, off = starts_of_blocks(symbols, known[v])[0]
        columns.append([min(FAR, x + off + least) for x in vectors[number]])
    return [columns[t][s] for s in range(4) for t in range(4)]


def traced(symbols: str, ahead: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    """(edits' initials, cost, state after) of the ASCII-least of the cheapest ways from a state through symbols to costs `ahead`.

    Block by block: costs at its start are looked up, those within it are found again from its end backward. Then each
    row takes the least initial that keeps to the cheapest cost, an insert before it too. Inserts after the last row
    belong to it only if nothing follows.
    """
    known, vectors, _ = tables()
    v, least = normal(ahead)
    marks = starts_of_blocks(symbols, known[v])
    out, cost = [], 0
    for b in range(len(marks) - 1):
        number, off = marks[b + 1]
        block = symbols[b * BLOCK : (b + 1) * BLOCK]
        inside = [tuple(x + off for x in vectors[number])]
        for s in reversed(block):
            inside.append(before(s, inside[-1]))
        inside.reverse()
        for i, s in enumerate(block):
            while True:
                here = inside[i][state]
                edits = [(e, c, to) for e, c, to in row_edits(state, s) if c + inside[i + 1][to] == here]
                if INSERT + inside[i][turn_after(state)] == here:
                    edits.append(("I", INSERT, turn_after(state)))
                edit, price, state = min(edits)
                out.append(edit)
                cost += price
                if edit != "I":
                    break
    while last and state not in WHOLE:
        out.append("I")
        cost, state = cost + INSERT, turn_after(state)
    return "".join(out), cost, state


@lean
def crossings(batches):
    """Segments with the costs through them."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([through(as_symbols(s)) for s in batch["symbols"].to_pylist()], pa.list_(pa.int64()))], names=[*batch.schema.names, "through"])


def as_symbols(faults: str) -> str:
    return "".join(DOUBLE.get(f, f) for f in faults)


def with_next(batches, columns: tuple[str, ...]):
    """Each row of the batches, and the one after it or None."""
    held = None
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in columns), strict=True):
            if held is not None:
                yield held, row
            held = row
    if held is not None:
        yield held, None


@lean
def ways(batches):
    """Segments sorted by conversation, the last first; to each the ways through it from all states it may begin in.

    What a conversation costs from a segment's end on is carried from the segments after it; nothing else is held.
    """
    conv, ahead, made = (), END, []
    kinds = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("symbols", pa.string()), ("ways", pa.list_(pa.struct([("edits", pa.string()), ("cost", pa.int64()), ("to", pa.int64())])))])
    for (key, seg, symbols, through_), after in with_next(batches, ("conv", "seg", "symbols", "through")):
        last, first = (key,) != conv, after is None or after[0] != key
        if last:
            conv, ahead = (key,), END
        starts = [NOTHING] if first else [s for s in range(4) if ahead_from(through_, ahead, s) < FAR]
        found = {s: dict(zip(("edits", "cost", "to"), traced(as_symbols(symbols), ahead, s, last), strict=True)) for s in starts}
        made.append({"conv": key, "seg": seg, "symbols": symbols, "ways": [found.get(s) for s in range(4)]})
        if not first:
            ahead = tuple(ahead_from(through_, ahead, s) for s in range(4))
        if len(made) == BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(made, schema=kinds)
            made = []
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=kinds)


def ahead_from(through_: list[int], ahead: tuple[int, ...], state: int) -> int:
    return min(FAR, min(through_[4 * state + t] + ahead[t] for t in range(4)))


@lean
def chosen(batches):
    """Segments sorted by conversation, the first first; of each the way that the one before leads to."""
    conv, state = (), NOTHING
    for batch in batches:
        edits, costs, starts = [], [], []
        for key, found in zip(batch["conv"].to_pylist(), batch["ways"].to_pylist(), strict=True):
            if (key,) != conv:
                conv, state = (key,), NOTHING
            way = found[state]
            edits.append(way["edits"])
            costs.append(way["cost"])
            starts.append(state)
            state = way["to"]
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["seg"], batch["symbols"], pa.array(edits, pa.string()), pa.array(costs, pa.int64()), pa.array(starts, pa.int64())], names=["conv", "seg", "symbols", "edits", "cost", "start"])


class Repair:
    """One conversation as its rows stream by: its counts, and the hash of its repaired text."""

    LEGAL = ("su", "ua", "au")

    def __init__(self, conv):
        self.conv, self.hash, self.any, self.audit = conv, sha256(), False, []
        self.turns, self.first, self.last, self.initial = 0, None, None, None
        self.faults, self.illegal, self.cost = {"b": 0, "d": 0, "t": 0}, 0, 0
        self.edits, self.at, self.symbols, self.row, self.state = "", 0, "", 0, NOTHING

    def segment(self, edits: str, symbols: str, cost: int, start: int) -> None:
        self.end_of_segment()
        self.edits, self.symbols, self.at, self.row, self.state = edits, symbols, 0, 0, start
        self.cost += cost
        self.audit.append(edits)

    def emit(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def turn(self, text: str) -> None:
        self.state = turn_after(self.state)
        self.emit("user" if self.state == USER else "assistant", text)

    def inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.turn("")
            self.at += 1

    def take(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += self.last != turn
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.initial is not None and self.initial + role[:1] not in self.LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        fault = self.symbols[self.row]
        self.row += 1
        if fault in "bd" or fault.isupper():
            self.faults[fault if fault in "bd" else "t"] += 1
        self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.emit(role, text)
            self.state = kept_after(self.state, fault)
        elif edit == "R":
            self.turn(text)

    def end_of_segment(self) -> None:
        self.inserts()

    def result(self) -> tuple:
        self.end_of_segment()
        gaps = 0 if self.first is None else min(2**63 - 1, self.last - self.first + 1 - self.turns)
        f = self.faults
        return self.conv, gaps, f["b"], f["d"], f["t"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


RESULT = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


@lean
def results(batches):
    """Rows sorted by conversation, segment and place, each segment's edits before its rows; a row per conversation."""
    at, done = None, []

    def flush():
        columns = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, RESULT, strict=True)], names=[c for c, _ in RESULT])

    for batch in batches:
        for conv, pos, turn, role, text, symbols, edits, cost, start in zip(*(batch[c].to_pylist() for c in ("conv", "pos", "turn", "role", "text", "symbols", "edits", "cost", "start")), strict=True):
            if at is None or conv != at.conv:
                if at is not None:
                    done.append(at.result())
                at = Repair(conv)
            if pos < 0:
                at.segment(edits, symbols, cost, start)
            else:
                at.take(turn, role, text)
        if done:
            yield flush()
            done.clear()
    if at is not None:
        done.append(at.result())
        yield flush()


def damage_code(conv: Column, turn: Column) -> Column:
    """crc32 of `conv_id:turn`, nulls written as one space, modulo 20."""
    text = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)))
    return (F.crc32(text.cast("binary")) % 20).cast("int")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with planted damage, by damage_code: 0 drops a row, 1 empties its text, 2 takes its ends of sentences,
    3 repeats it, 4 makes its role user. Null role and text become one space."""
    code = damage_code(F.col("conv_id"), F.col("turn"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(F.col("text"), ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.alias("code")).where("code <> 0")
    times = F.explode(F.sequence(F.lit(0), F.when(F.col("code") == 3, 1).otherwise(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of repair(), dealt and sorted by conversation and turn, stored, with seg and pos that ascend in this order.

    Rows of one turn follow their role, then a hash of their text. A conversation may span tasks; a segment doesn't.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.coalesce(F.nullif(F.regexp_extract("role", "^[sua]", 0), F.lit("")), F.lit("o"))
    own = F.when(blank, "b").otherwise(F.when(truncated, F.upper(initial)).otherwise(initial))
    keyed = rows.select(F.col("conv_id").alias("conv"), "turn", "role", "text", own.alias("own"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(7), "role").alias("h2"))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]
    dealt = keyed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = dealt.withColumn("pos", F.monotonically_increasing_id())
    return stored(placed.withColumn("seg", F.shiftright("pos", SEGMENT_BITS)), "turns")


def segments(turns: DataFrame) -> DataFrame:
    """(conv, seg, symbols): the rows of a segment as letters; those with role and text of an earlier row of the conversation are d."""
    first = turns.groupBy("conv", "h1", "h2").agg(F.min("pos").alias("pos")).select("conv", F.shiftright("pos", SEGMENT_BITS).alias("seg"), "pos", F.lit(None).cast("string").alias("own"))
    marks = turns.select("conv", "seg", "pos", "own").unionByName(first).groupBy("conv", "seg", "pos").agg(F.max("own").alias("own"), (F.count("*") == 1).alias("again"))
    letter = F.when((F.col("own") != "b") & F.col("again"), "d").otherwise(F.col("own"))
    letters = F.sort_array(F.collect_list(F.struct("pos", letter.alias("letter"))))
    return marks.groupBy("conv", "seg").agg(F.concat_ws("", F.transform(letters, lambda x: x["letter"])).alias("symbols"))


def tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has: rows are few bytes here, so that adaptive execution would merge them into too few."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


WAYS = "array<struct<edits: string, cost: long, to: long>>"


def traces(parts: DataFrame) -> DataFrame:
    """(conv, seg, symbols, edits, cost, start): the repair of each segment, as the whole conversation's cheapest one has it.

    Costs through segments are found apart. A conversation's segments then meet in one task, but stream through it twice,
    256 rows at a time and as some bytes a row: backward with the costs ahead, forward with the state that was reached.
    """
    crossed = parts.mapInArrow(crossings, "conv long, seg long, symbols string, through array<long>")
    backward = crossed.repartition(tasks(parts), "conv").sortWithinPartitions("conv", F.col("seg").desc()).mapInArrow(ways, f"conv long, seg long, symbols string, ways {WAYS}")
    return backward.sortWithinPartitions("conv", "seg").mapInArrow(chosen, "conv long, seg long, symbols string, edits string, cost long, start long")


def repair(rows: DataFrame) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text; none null but ids and turns) its faults and cheapest repair.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Rows stand by turn, nulls
    first; rows of one turn by role and a hash of their text, equal rows side by side. A null conv_id is one conversation.
    Roles that begin with other letters than s, u and a (or are empty) can't be kept. Columns other than the four aren't
    looked at. An empty table gives an empty one.

    The hash of a conversation's text takes its rows one after another by its nature: they stream through one task.
    """
    turns = in_order(rows)
    edits = traces(segments(turns))
    none = lambda kind: F.lit(None).cast(kind)
    texts = turns.select("conv", "seg", "pos", "turn", "role", "text", none("string").alias("symbols"), none("string").alias("edits"), none("long").alias("cost"), none("long").alias("start"))
    heads = edits.select("conv", "seg", F.lit(-1).cast("long").alias("pos"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), "symbols", "edits", "cost", "start")
    kinds = ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in RESULT)
    return texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "seg", "pos").mapInArrow(results, kinds)


def repaired(rows: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """repair(rows), with a row of zeros for each conversation of `original` of which no row is left."""
    found = repair(rows)
    if original is None:
        return found
    ids = original.select(F.col("conv_id").alias("_id")).distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    both = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return both.select(F.col("_id").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def op13_repair_conversations(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(damaged(rows), rows)
