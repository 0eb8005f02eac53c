"""Conversation repair: the cheapest edits that give each conversation an order of roles that can be trained on.

A whole conversation's role initials read ``(s?(ua)+)?``. Turns are kept (cost 0), given the role that is due
(Rerole, 3), or deleted (4); empty turns of the role that is due are inserted (3). Blank and repeated turns must be
deleted, and a truncated turn that stays costs 3 more.

The search is a dynamic program with a layer for each turn and four states (nothing yet, after s, after u,
after a). A layer's step is a macro edit: a run of inserts, then what happens to the turn. Their codes
(``K``, ``ID``, ``IIR``, ...) end in the only letter that is not I, so none is the beginning of another, and
of two audit strings of a layer neither is the beginning of the other: they are ordered by
their first differing code. A layer hence keeps the *rank* of each state's best string in place of the string,
and the next layer orders by (cost, rank of the parent, code). Strings are put together at the end along parent
pointers. Ranks and costs, less the layer's least, take few values, so that layers are looked up
after they have been met once, and a turn costs a task one lookup and one pointer.

Turns are dealt by ranges of (conversation, turn), so a long one is spread over many tasks. Texts stay there:
a turn goes to the search as one letter (initial and fault), gathered to a string as long as the audit,
and comes back as edits that are joined by position. Digests stream over the repaired turns of a
conversation in order and hold none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from recordloom.llm.common import durable, hot_join, tidied

#: Costs of the edits, and of a truncated turn that stays.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: White space of the rules.
SPACE = " \t\n\x0b\f\r"
FAULTS = ["fine", "blank", "duplicate", "truncated"]
#: A turn's letter is the one in the place 4 * initial + fault.
INITIALS, LETTERS = "sua?", "ABCDEFGHIJKLMNOP"
ROLES = {"u": "user", "a": "assistant"}
#: Where an initial leads from each state, and the initial that is due; a conversation may end in 0 and 3.
LEADS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
DUE = "uuau"
ENDS = (0, 3)
#: More inserts in a row would hold a pair that can be left out.
MOST = 2
#: Turns of a piece of a conversation, and rows that tasks gather before they send them.
PIECE, SENT = 1 << 16, 1 << 14

#: A layer: for each state (cost above the layer's least, rank of its audit), or None.
Layer = tuple[tuple[int, int] | None, ...]
START: Layer = ((0, 0), None, None, None)


def _inserted(state: int, k: int) -> tuple[int, str]:
    """The state after ``k`` inserts, and their initials."""
    initials = ""
    for _ in range(k):
        initials += DUE[state]
        state = LEADS[state][DUE[state]]
    return state, initials


def _moves(letter: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, code) of the macro edits of a turn."""
    initial, fault = divmod(LETTERS.index(letter), 4)
    found = []
    for before in range(4):
        for k in range(MOST + 1):
            state, _ = _inserted(before, k)
            code = "I" * k
            found.append((before, state, k * INSERT + DELETE, code + "D"))
            if FAULTS[fault] in ("fine", "truncated"):
                stays = k * INSERT + TRUNCATED * (FAULTS[fault] == "truncated")
                found.append((before, LEADS[state][DUE[state]], stays + REROLE, code + "R"))
                if INITIALS[initial] in LEADS[state]:
                    found.append((before, LEADS[state][INITIALS[initial]], stays, code + "K"))
    return found


class Search:
    """Audits of conversations; layers met before are remembered, which are a few hundred."""

    def __init__(self):
        self.moves = {letter: _moves(letter) for letter in LETTERS}
        self.met: dict[tuple[Layer, str], tuple[int, Layer, tuple]] = {}

    def _step(self, layer: Layer, letter: str) -> tuple[int, Layer, tuple]:
        """The layer's least cost above that of the one before, the layer, and (parent, code) of each state."""
        best: list = [None] * 4
        for before, after, cost, code in self.moves[letter]:
            if layer[before] is not None:
                above, rank = layer[before]
                way = (above + cost, rank, code, before)
                best[after] = way if best[after] is None else min(best[after], way)
        least = min(way[0] for way in best if way)
        ranks = {way[1:3]: i for i, way in enumerate(sorted((w for w in best if w), key=lambda w: w[1:3]))}
        layer = tuple(way and (way[0] - least, ranks[way[1:3]]) for way in best)
        return least, layer, tuple(way and (way[3], way[2]) for way in best)

    def audit(self, letters: str) -> tuple[int, list[str]]:
        """The cost, and a code for each turn and one of trailing inserts."""
        layer, total, pointers = START, 0, []
        for letter in letters:
            step = self.met.get((layer, letter))
            if step is None:
                step = self.met[layer, letter] = self._step(layer, letter)
            least, layer, pointer = step
            total += least
            pointers.append(pointer)
        ways = [(at[0] + k * INSERT, at[1], k, s) for s, at in enumerate(layer) if at for k in range(MOST + 1) if _inserted(s, k)[0] in ENDS]
        above, _, k, state = min(ways)
        codes = ["I" * k]
        for pointer in reversed(pointers):
            state, code = pointer[state]
            codes.append(code)
        return total + above, codes[::-1]


def edits(letters: str, codes: list[str]) -> Iterator[tuple[int, str, str | None]]:
    """(turn, edit, role) of what a conversation holds after its edits; the role is None where it stays."""
    state = 0
    for i, code in enumerate(codes):
        for edit in code:
            at = min(i, len(letters) - 1)
            if edit == "D":
                continue
            role = None if edit == "K" else ROLES[DUE[state]]
            state = LEADS[state][INITIALS[LETTERS.index(letters[i]) // 4] if edit == "K" else DUE[state]]
            yield at, edit, role


def _letter(duplicate: Column) -> Column:
    initial = F.when(F.col("initial").isin(*INITIALS[:-1]), F.instr(F.lit(INITIALS), F.col("initial")) - 1).otherwise(len(INITIALS) - 1)
    fault = F.when(F.col("last") == "", 1).when(duplicate, 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    return F.substring(F.lit(LETTERS), 4 * initial + fault + 1, F.lit(1))


@tidied
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of position, as runs of one conversation with consecutive positions."""
    key, start, letters = None, None, []

    def piece(schema: pa.Schema) -> pa.RecordBatch:
        values = [pa.array([key], schema.field("conv").type), pa.array([start]), pa.array(["".join(letters)])]
        return pa.RecordBatch.from_arrays(values, ["conv", "start", "letters"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for conv, pos, letter in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "letter"))):
            if start is None or conv != key or pos != start + len(letters) or len(letters) == PIECE:
                if letters:
                    yield piece(schema)
                key, start, letters = conv, pos, []
            letters.append(letter)
    if letters:
        yield piece(schema)


@tidied
def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = Search()
    for batch in batches:
        out: dict[str, list] = {name: [] for name in ("illegal", *FAULTS[1:], "cost", "codes")}
        for pieces in batch.column("pieces").to_pylist():
            letters = "".join(p["letters"] for p in pieces)
            numbers = [LETTERS.index(x) for x in letters]
            initials = [INITIALS[x // 4] for x in numbers]
            out["illegal"].append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))
            for i, fault in enumerate(FAULTS):
                if i:
                    out[fault].append(sum(x % 4 == i for x in numbers))
            cost, codes = search.audit(letters)
            out["cost"].append(cost)
            out["codes"].append(" ".join(codes))
        columns = [pa.array(v, pa.string() if k == "codes" else pa.int64()) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("pieces"), *columns], ["conv", "pieces", *out])


@tidied
def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The position, place, edit and role of each repaired turn."""
    rows: list[tuple] = []
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
    send = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["pos", "nth", "edit", "due"])
    for batch in batches:
        for pieces, codes in zip(batch.column("pieces").to_pylist(), batch.column("codes").to_pylist()):
            places = (p["start"] + i for p in pieces for i in range(len(p["letters"])))
            at, pos, nth = -1, None, 0
            for turn, edit, role in edits("".join(p["letters"] for p in pieces), codes.split(" ")):
                while at < turn:
                    at, pos, nth = at + 1, next(places), 0
                rows.append((pos, nth, edit, role))
                nth += 1
                if len(rows) >= SENT:
                    yield send()
                    rows = []
    if rows:
        yield send()


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The report (``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired turns.

    The repaired turns are (``conv``, pos, nth, edit, role, text), in order of (pos, nth); edit is K, R or I.
    A conversation's turns are taken by turn (nulls first), ties by role and text; null roles and texts are
    one space. Rows without a conversation are one conversation. A fault is blank (nothing but space), else
    duplicate (role and text of an earlier turn), else truncated (the last character that is no space is none of
    ``.!?``). gaps is the number of turns missing between the first and the last, nulls ignored; illegal
    counts neighbours whose role initials are none of su, ua and au. A role of no letters has no initial and is
    kept nowhere. Conversations without rows are not there; no rows give no rows. Other columns play no part.
    """
    words = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(conv).alias("id"), F.col(turn).cast("long").alias("turn"), words(role).alias("role"), words(text).alias("text"))
    by = [F.asc_nulls_first("id"), F.asc_nulls_first("turn"), "role", "text"]
    rows = durable(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.struct("id").alias("conv"), "turn", "role", "text", F.monotonically_increasing_id().alias("pos"))
    )
    mark = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    light = durable(rows.select("conv", "turn", "pos", F.substring("role", 1, 1).alias("initial"), last.alias("last"), mark.alias("mark")))
    repeated = durable(light.groupBy("conv", "mark").agg(F.min("pos").alias("first"), F.count("*").alias("m")).where("m > 1"))
    again = durable(hot_join(light.select("conv", "mark", "pos"), repeated, ["conv", "mark"], "m").where("pos > first").select("pos", F.lit(True).alias("again")))
    marked = light.join(again, "pos", "left").select("conv", "pos", _letter(F.coalesce("again", F.lit(False))).alias("letter"))
    kind = light.schema["conv"]
    piece = StructType([kind, StructField("start", LongType()), StructField("letters", StringType())])
    pieces = marked.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(_pieces, piece)
    # as long as the audit is, which is one value of one row
    whole = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("start", "letters"))).alias("pieces"))
    counts = [StructField(c, LongType()) for c in ("illegal", *FAULTS[1:], "cost")]
    audits = durable(whole.mapInArrow(_audits, StructType([kind, whole.schema["pieces"], *counts, StructField("codes", StringType())])))
    gaps = light.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    report = audits.join(gaps, "conv").select(
        F.col("conv.id").alias(conv), "gaps", *FAULTS[1:], "illegal", "cost", F.replace("codes", F.lit(" "), F.lit("")).alias("audit")
    )
    edit = StructType([StructField("pos", LongType()), StructField("nth", IntegerType()), StructField("edit", StringType()), StructField("due", StringType())])
    edited = audits.select("pieces", "codes").mapInArrow(_edited, edit)
    repaired = edited.join(rows.select("conv", "pos", "role", "text"), "pos").select(
        F.col("conv.id").alias(conv), "pos", "nth", "edit", F.coalesce("due", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")
    )
    return report, repaired


def digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(``conv``, repaired_sha256): the digest of each conversation's ``role:text`` lines, which are streamed in order."""

    @tidied
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, schema = None, None, None
        out = lambda done: pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], schema.field(0).type), pa.array([h for _, h in done])], ["conv", "repaired_sha256"])
        for batch in batches:
            schema, done = batch.schema, []
            lines = pc.cast(batch.column("line"), pa.binary())
            for conv_of, line in zip(batch.column("conv").to_pylist(), lines):
                if held is None or conv_of != key:
                    if held is not None:
                        done.append((key, held.hexdigest()))
                    key, held = conv_of, hashlib.sha256(line.as_py())
                else:
                    held.update(b"\n")
                    held.update(line.as_py())
            if done:
                yield out(done)
        if held is not None:
            yield out([(key, held.hexdigest())])

    rows = repaired.select(F.struct(F.col(conv).alias("id")).alias("conv"), "pos", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "pos", "nth").select("conv", "line")
    found = ordered.mapInArrow(stream, StructType([ordered.schema["conv"], StructField("repaired_sha256", StringType())]))
    return found.select(F.col("conv.id").alias(conv), "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) damaged by a hash of conversation and turn: dropped, emptied, unpunctuated, repeated or of another role."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), h.alias("h")).where("h <> 0")
    times = F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """The report of each conversation of ``turns`` after damage, with the digest of its repaired turns; of those without turns left too."""
    report, repaired = repair(damaged(turns))
    key = F.struct("conv_id").alias("conv")  # so that null meets null
    found = report.select(key, *report.columns[1:]).join(digests(repaired).select(key, "repaired_sha256"), "conv", "left")
    every = turns.select("conv_id").distinct().select(key)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(found, "conv", "left").select(
        F.col("conv.conv_id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )


#: The same by plain strings: whole audits and whole repaired texts are carried from turn to turn.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT x, x AS c, 0 AS i FROM range(256) r(x)
  UNION ALL SELECT x, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY x) AS t FROM bits WHERE i = 8),
hashed AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      LAMBDA c, b : xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS h
  FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS time FROM hashed WHERE h <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
judged AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au') AS clash FROM numbered),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (clash) AS illegal, max(n) AS n FROM judged GROUP BY conv_id),
due(state, role, next) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
inserts AS MATERIALIZED (SELECT state AS a, state AS b, 0 AS cost, '' AS code, CAST([] AS VARCHAR[]) AS lines FROM due
  UNION ALL SELECT state, next, 3, 'I', [role || ':'] FROM due
  UNION ALL SELECT d.state, e.next, 6, 'II', [d.role || ':', e.role || ':'] FROM due d JOIN due e ON d.next = e.state),
kept(state, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ways AS MATERIALIZED (SELECT a, b, cost + 4 AS cost, code || 'D' AS code, lines, CAST(NULL AS VARCHAR) AS initial, CAST(NULL AS VARCHAR) AS role FROM inserts
  UNION ALL SELECT a, next, cost + 3, code || 'R', lines, NULL, role FROM inserts JOIN due ON b = state
  UNION ALL SELECT a, next, cost, code || 'K', lines, initial, NULL FROM inserts JOIN kept ON b = state),
steps AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, struct_pack(cost := CAST(0 AS BIGINT), audit := '', lines := CAST([] AS VARCHAR[])) AS best FROM sums
  UNION ALL SELECT s.conv_id, j.n, w.b, min(struct_pack(
      cost := s.best.cost + w.cost + CASE WHEN fault = 'truncated' AND code NOT LIKE '%D' THEN 3 ELSE 0 END, audit := s.best.audit || w.code,
      lines := s.best.lines || w.lines || CASE WHEN code LIKE '%D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(w.role, j.role) || ':' || j.text] END))
    FROM steps s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.n = s.n + 1
    JOIN ways w ON w.a = s.state AND (w.initial IS NULL OR w.initial = j.initial) AND (coalesce(fault, '') NOT IN ('blank', 'duplicate') OR code LIKE '%D')
    GROUP BY s.conv_id, j.n, w.b),
ended AS (SELECT s.conv_id, min(struct_pack(cost := best.cost + i.cost, audit := best.audit || i.code, lines := best.lines || i.lines)) AS best
  FROM steps s JOIN sums t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.n = t.n JOIN inserts i ON i.a = s.state AND i.b IN (0, 3) GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
