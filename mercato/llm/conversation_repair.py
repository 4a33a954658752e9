"""Operator 12, conversation structure repair by weighted CYK parsing.

The rows of a conversation, in the order of their turn, are repaired by
edits so that their roles' first letters read ``(s?(ua)+)?``. The grammar of
that language and of the edits is in Chomsky normal form over spans of rows:

    Conversation -> Body | System Body | Nothing       (or no row at all)
    Body         -> User Answer | Body Pair            Pair -> User Answer
    User         -> Nothing User | User Nothing        and so for Answer, System
    Nothing      -> Nothing Nothing
    User         -> a row kept or given a role; Answer -> likewise
    System       -> a row kept; Nothing -> a row deleted

A cell holds, for each symbol that can derive its span, the cheapest (cost,
audit). ``User`` and ``Answer`` also derive no row at all, by an insertion:
those derivations of the empty span are closed once, and every cell is closed
under the rules with one empty side. Cells are combined bottom-up by span
length, over all split points.

Equal costs mean equal edits but for their order, so neither of two audits of
one cell and cost is the start of the other, and the smaller of two parts
gives the smaller whole.

A conversation of more than ``CHART`` rows is parsed in blocks: the symbols
of the block chart are then pairs of border states (what stands before the
span, what after), for which the same binary rules hold at every split, and
the blocks' cells are combined bottom-up in turn. So a chart has a bounded
size and a conversation of any length costs time in proportion to it.

The rows' faults are windows over (conversation, row) and spread over all
tasks; a parse sees one letter per row, and equal letter rows are parsed once
per task. The repaired text is made in one pass over the sorted rows, which
is inherent to an ordered digest; no list of a conversation's texts is held.

Cases: null role or text is one space (``NULL``); a null turn comes first; a
null conv_id is a conversation of its own; rows with the same turn follow
role, then text; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shuffle_partitions, stored, table

# The costs and letters of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NULL = " "
CHART = 24  # rows of a block of a long conversation

# The grammar. Binary rules: the symbol, its left and its right part.
RULES = (("Conversation", "System", "Body"), ("Conversation", "User", "Answer"), ("Conversation", "Body", "Pair"),
         ("Body", "User", "Answer"), ("Body", "Body", "Pair"), ("Pair", "User", "Answer"), ("Nothing", "Nothing", "Nothing"),
         *((x, "Nothing", x) for x in ("User", "Answer", "System")), *((x, x, "Nothing") for x in ("User", "Answer", "System")))
UNIT = (("Conversation", "Nothing"),)
# Border states for blocks: at the start, after s, after u, after a.
STATES = "0sua"
BORDER_RULES = tuple((p + r, p + q, q + r) for p in STATES for q in STATES for r in STATES)

Cell = dict[str, tuple[int, str]]


def put(cell: Cell, symbol: str, cost: int, audit: str) -> bool:
    known = cell.get(symbol)
    if known is None or (cost, audit) < known:
        cell[symbol] = (cost, audit)
        return True
    return False


def empty_cell(rules, inserted: Cell, free: tuple = ()) -> Cell:
    """What derives the empty span: insertions and all that follows."""
    cell = dict(inserted) | {x: (0, "") for x in free}
    changed = True
    while changed:
        changed = False
        for a, b, c in rules:
            if b in cell and c in cell:
                changed |= put(cell, a, cell[b][0] + cell[c][0], cell[b][1] + cell[c][1])
    return cell


def closed(cell: Cell, rules, unit, empty: Cell) -> Cell:
    """The cell under the rules with one side that derives no row."""
    changed = True
    while changed:
        changed = False
        for a, b, c in rules:
            if b in cell and c in empty:
                changed |= put(cell, a, cell[b][0] + empty[c][0], cell[b][1] + empty[c][1])
            if b in empty and c in cell:
                changed |= put(cell, a, empty[b][0] + cell[c][0], empty[b][1] + cell[c][1])
        for a, b in unit:
            if b in cell:
                changed |= put(cell, a, *cell[b])
    return cell


def chart(leaves: list[Cell], rules, unit, empty: Cell) -> Cell:
    """The cell of the whole span: cells by span length, all split points."""
    n = len(leaves)
    cells = {(i, i + 1): closed(dict(leaf), rules, unit, empty) for i, leaf in enumerate(leaves)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                left, right = cells[i, k], cells[k, i + length]
                for a, b, c in rules:
                    if b in left and c in right:
                        put(cell, a, left[b][0] + right[c][0], left[b][1] + right[c][1])
            cells[i, i + length] = closed(cell, rules, unit, empty)
    return cells[0, n]


def edits(letter: str) -> list[tuple[str, int, str]]:
    """What a row may become: the letter of its new role (none: deleted),
    cost, audit. ``letter``: the role's initial, in upper case if the row is
    truncated, and '-' for rows that have to be deleted."""
    out = [("", DELETE, "D")]
    if letter != "-":
        extra = TRUNCATED if letter.isupper() else 0
        own = letter.lower()
        if own in "sua":
            out.append((own, KEEP + extra, "K"))
        out += [(x, REROLE + extra, "R") for x in "ua" if x != own]
    return out


SYMBOL = {"u": "User", "a": "Answer", "s": "System", "": "Nothing"}
EMPTY = empty_cell(RULES, {"User": (INSERT, "I"), "Answer": (INSERT, "I")})
BORDER_STEPS = {"u": ("0u", "su", "au"), "a": ("ua",), "s": ("0s",), "": tuple(x + x for x in STATES)}
BORDER_EMPTY = empty_cell(BORDER_RULES, {x: (INSERT, "I") for y in "ua" for x in BORDER_STEPS[y]}, BORDER_STEPS[""])


@lru_cache(1 << 16)
def short_repair(letters: str) -> tuple[int, str]:
    leaves: list[Cell] = []
    for letter in letters:
        leaf: Cell = {}
        for role, cost, audit in edits(letter):
            put(leaf, SYMBOL[role], cost, audit)
        leaves.append(leaf)
    return chart(leaves, RULES, UNIT, EMPTY)["Conversation"]


def border_leaf(letter: str) -> Cell:
    leaf: Cell = {}
    for role, cost, audit in edits(letter):
        for border in BORDER_STEPS[role]:
            put(leaf, border, cost, audit)
    return leaf


def repair(letters: str, block: int = CHART) -> tuple[int, str]:
    """The cheapest (cost, audit) of a conversation, given as letters."""
    if not letters:
        return 0, ""
    if len(letters) <= block:
        return short_repair(letters)
    # blocks bottom-up by their length: two of one length become one, and only
    # one of each length is held
    spans: list[tuple[int, Cell]] = []
    for at in range(0, len(letters), block):
        spans.append((1, chart([border_leaf(x) for x in letters[at:at + block]], BORDER_RULES, (), BORDER_EMPTY)))
        while len(spans) > 1 and spans[-1][0] == spans[-2][0]:
            n, right = spans.pop()
            spans.append((2 * n, chart([spans.pop()[1], right], BORDER_RULES, (), BORDER_EMPTY)))
    while len(spans) > 1:
        _, right = spans.pop()
        spans.append((0, chart([spans.pop()[1], right], BORDER_RULES, (), BORDER_EMPTY)))
    whole = spans[0][1]
    return min(whole[x] for x in ("00", "0a") if x in whole)


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage, by crc32(``conv_id:turn``) modulo 20: 0 drops a
    row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets the
    role ``user``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    case = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    return (rows.withColumn("_case", case).where("_case != 0")
            .withColumn("text", F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")))
            .withColumn("_times", F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("_case", "_times"))


def plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(NULL)).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(NULL)).alias("text"))


def order() -> tuple[Column, ...]:
    """The order of the rows of a conversation."""
    return F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")


def fault() -> Column:
    """The first fault of a row: blank, duplicate, truncated or none."""
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return (F.when(last == "", "blank").when(F.col("copy") > 1, "duplicate")
            .when(~last.isin(".", "!", "?"), "truncated").otherwise("none"))


def graded(rows: DataFrame) -> DataFrame:
    """The rows with ``copy`` (the how many-th with this role and text in its
    conversation), ``fault`` and ``letter``, the input of the parse."""
    same = W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return (rows.withColumn("copy", F.row_number().over(same)).withColumn("fault", fault())
            .withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), "-")
                        .when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)))


REPAIRED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired_sha256 string")


class _Conversation:
    """The rows of a conversation as they come, sorted: counts and letters in
    the first pass over them, the repaired text in the second."""

    def __init__(self):
        self.turns: list = [None, None, 0, None]  # least, most, distinct, last
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
        self.illegal, self.before, self.letters = 0, None, []

    def add(self, turn, role: str, fault_: str, letter: str) -> None:
        if turn is not None:
            t = self.turns
            t[0], t[1] = (turn, turn) if t[0] is None else (min(t[0], turn), max(t[1], turn))
            t[2], t[3] = t[2] + (turn != t[3]), turn
        self.counts[fault_] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.letters.append(letter)

    def numbers(self) -> list[int]:
        least, most, distinct, _ = self.turns
        gaps = 0 if least is None else most - least + 1 - distinct
        return [gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal]


def new_roles(audit: str) -> Iterator[tuple[str, str]]:
    """(edit, letter of the row's new role): an odd number of rows starts
    with s, then u and a follow each other."""
    size = len(audit) - audit.count("D")
    at = 0
    for edit in audit:
        if edit == "D":
            yield edit, ""
            continue
        yield edit, "s" if size % 2 and at == 0 else "ua"[(at - size % 2) % 2]
        at += 1


FULL = {"u": "user", "a": "assistant"}


class _Digest:
    """The repaired text, row by row."""

    def __init__(self, audit: str):
        self.steps, self.sha, self.first = new_roles(audit), hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def add(self, role: str, text: str) -> None:
        for edit, new in self.steps:
            if edit == "I":
                self.put(FULL[new], "")
                continue
            if edit != "D":
                self.put(role if edit == "K" else FULL[new], text)
            return

    def end(self) -> str:
        for _, new in self.steps:
            self.put(FULL[new], "")
        return self.sha.hexdigest()


def parsed(rows: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit) of each conversation of graded rows."""
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, done = None, None, []

        def finished():
            cost, audit = repair("".join(own.letters))
            done.append((current, *own.numbers(), cost, audit))

        for batch in batches:
            for conv, turn, role, fault_, letter in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if own is None or conv != current:
                    if own is not None:
                        finished()
                    current, own = conv, _Conversation()
                own.add(turn, role, fault_, letter)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        if own is not None:
            finished()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order())
    return dealt.select("conv_id", "turn", F.substring("role", 1, 1), "fault", "letter").mapInArrow(
        work, ", ".join(f"{n} {'string' if n == 'audit' else 'long'}" for n in names))


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) by streaming the sorted rows along the
    audit, which comes before them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, done = None, None, []
        for batch in batches:
            for conv, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind == 0:
                    if own is not None:
                        done.append((current, own.end()))
                    current, own = conv, _Digest(text)
                else:
                    own.add(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.string()))],
                                                 ["conv_id", "repaired_sha256"])
                done = []
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([own.end()])], ["conv_id", "repaired_sha256"])

    n = shuffle_partitions(rows.sparkSession)
    null = F.lit(None)
    heads = audits.select("conv_id", F.lit(0).alias("kind"), null.cast("long").alias("turn"), null.cast("string").alias("role"),
                          F.col("audit").alias("text"), F.lit(0).alias("copy"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copy"))
    dealt = both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", *order())
    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(work, "conv_id long, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of
    (conv_id, turn, role, text)."""
    own = graded(plain(rows))
    audits = stored(parsed(own), "audits")
    out = audits.alias("a").join(digests(own, audits).alias("d"),
                                 F.col("a.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    return out.select("a.*", "d.repaired_sha256")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the conversations as repaired."""
    own = graded(plain(rows))
    audits = parsed(own).select(F.col("conv_id").alias("_conv"), "audit")
    numbered = own.withColumn("_row", F.row_number().over(W.partitionBy("conv_id").orderBy(*order())))
    size = F.length(F.regexp_replace("audit", "D", ""))
    edits_ = audits.select("_conv", size.alias("_size"), F.posexplode(F.split("audit", "(?<=.)(?=.)")).alias("_at", "_edit")).where("_edit != ''")
    along = W.partitionBy("_conv").orderBy("_at")
    edits_ = (edits_.withColumn("_row", F.sum((F.col("_edit") != "I").cast("int")).over(along))
              .withColumn("position", F.sum((F.col("_edit") != "D").cast("int")).over(along) - 1).where("_edit != 'D'"))
    odd = F.col("_size") % 2
    role = F.when((F.col("position") - odd) % 2 == 0, "user").otherwise("assistant")
    hit = (F.col("_conv").eqNullSafe(F.col("conv_id"))) & (numbered["_row"] == edits_["_row"]) & (F.col("_edit") != "I")
    return edits_.join(numbered, hit, "left").select(
        F.col("_conv").alias("conv_id"), "position", F.when(F.col("_edit") == "K", F.col("role")).otherwise(role).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that lost all their rows to the damage are added."""
    rows = plain(table(spark, sf_dir, "conversations"))
    done = repair_conversations(damaged(rows))
    every = rows.select(F.col("conv_id").alias("_conv")).distinct()
    out = every.join(done, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE_SQL = {"op12_conversation_repair": r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), keys AS (
  SELECT k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS n
  FROM (SELECT DISTINCT k FROM base)
), hurt AS (
  SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN n = 1 THEN '' WHEN n = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN n = 3 THEN [1, 2] ELSE [1] END) AS twice
  FROM base JOIN keys USING (k) WHERE n <> 0
), seen AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ended
  FROM hurt
), flawed AS (
  SELECT *, CASE WHEN regexp_matches(ended, '^[\x20\x09-\x0D]*$') THEN 'blank' WHEN copy > 1 THEN 'duplicate'
                 WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS prior
  FROM seen
), ins(p, q, a, c) AS (
  VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (1, 2, 'I', 3), (3, 2, 'I', 3), (2, 3, 'I', 3),
         (0, 3, 'II', 6), (1, 3, 'II', 6)
), step(kind, p, q, a, c) AS (
  SELECT kind, p, p, 'D', 4 FROM (VALUES ('s'), ('u'), ('a'), ('x')) t(kind), (VALUES (0), (1), (2), (3)) s(p)
  UNION ALL SELECT kind, p, q, CASE WHEN kind = new THEN 'K' ELSE 'R' END, CASE WHEN kind = new THEN 0 ELSE 3 END
  FROM (VALUES ('s'), ('u'), ('a'), ('x')) t(kind), (VALUES (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) s(p, q, new)
  UNION ALL SELECT 's', 0, 1, 'K', 0
), moves AS (
  SELECT kind, ins.p, step.q, ins.a || step.a AS a, ins.c + step.c AS c, step.a AS edit FROM ins JOIN step ON ins.q = step.p
), list AS (
  SELECT conv_id, i, fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS kind FROM flawed
), heads AS (
  SELECT conv_id, max(i) AS n FROM flawed GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, '00000000' AS best FROM heads
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.q, min(printf('%08d', left(w.best, 8)::BIGINT + m.c + CASE WHEN l.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END)
                                      || substr(w.best, 9) || m.a)
  FROM walk w JOIN list l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1
       JOIN moves m ON m.p = w.q AND m.kind = l.kind AND (m.edit = 'D' OR l.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, w.i, m.q
), ends AS (
  SELECT h.conv_id, min(printf('%08d', left(w.best, 8)::BIGINT + ins.c) || substr(w.best, 9) || ins.a) AS best
  FROM heads h JOIN walk w ON w.conv_id IS NOT DISTINCT FROM h.conv_id AND w.i = h.n JOIN ins ON ins.p = w.q
  WHERE ins.q = 3 OR (ins.q = 0 AND ins.p = 0) GROUP BY h.conv_id
), audits AS (
  SELECT conv_id, left(best, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM ends
), letters AS (
  SELECT conv_id, audit, pos, audit[pos] AS edit, length(replace(audit, 'D', '')) % 2 AS odd
  FROM audits, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS pos) u
), placed AS (
  SELECT *, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w - 1 AS o
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), repaired AS (
  SELECT p.conv_id, sha256(coalesce(string_agg(CASE WHEN p.edit = 'K' THEN f.role WHEN (p.o - p.odd) % 2 = 0 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN p.edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p.pos), '')) AS sha
  FROM placed p LEFT JOIN flawed f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.edit <> 'D' GROUP BY p.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND left(prior, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM flawed GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM base) b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
     LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM b.conv_id
"""}
