"""Repair of conversations by the cheapest edits: a dynamic program over persistent audits.

A conversation's roles must read `(s?(ua)+)?` by their initials. Its rows are kept (K, 0), given the role that fits (R, 1) or deleted
(D, 2, the only way for blank and repeated rows), and empty rows are inserted (I, 5); a truncated row that stays costs 5 more. Of equally
cheap audits the least one by its letters counts. Four states follow the pattern: nothing yet, after s, after u, after a.

1.  Rows are numbered in their conversation's order by ranges with prefix counts, so that no task orders a whole conversation.
2.  Segments of SEGMENT rows, wherever their conversation lies, are solved from each state they may begin in. Audits are linked nodes that share
    their prefixes, with ancestors by powers of two and rolling hashes: a tie is decided by searching the longest common prefix. An
    audit fixes the states that it goes through, so equal prefixes are one node; equal hashes of two nodes are a collision, which is noticed.
3.  Segments are composed along each conversation, a row for each segment, by the same program over nodes that hold a segment's letters each.
4.  The letters go back to the rows by (conversation, place), and SQL expressions write the repaired rows.

A conversation of any size is spread over tasks up to step 3, which reads four costs and strings for each segment. Only what is one value by
its nature, an audit or a digest of a whole conversation, is made in one task, and the digest by streaming.

Defined results: rows of a conversation are in the order of turn (null first), role and text, so that repeated rows are neighbours; a null
conv_id is a conversation of its own; a null role or text is one space; an empty role has no initial and can't be kept; any role that begins
with s, u or a can be kept in its place; initials are compared exactly; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_few, stage, table
from corpusloom.operators.ordering import placed
from corpusloom.session import ship

#: Rows of a conversation that are solved at once.
SEGMENT = 1024
SPACES = " \t\n\x0b\x0c\r"
_P, _BASE = (1 << 61) - 1, 1_000_003
#: Fault codes.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: State after a role's initial: nothing yet 0, s 1, u 2, a 3. From where it may be reached.
_AFTER = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}


class Node:
    """The end of an audit: its last piece, and its ancestors at 1, 2, 4, ... pieces back."""

    __slots__ = ("piece", "depth", "hash", "ups")

    def __init__(self, up: Node | None = None, piece: str = ""):
        self.piece = piece
        if up is None:
            self.depth, self.hash, self.ups = 0, 0, ()
            return
        self.depth = up.depth + 1
        self.hash = (up.hash * _BASE + (ord(piece) if len(piece) == 1 else zlib.crc32(piece.encode()) + 256)) % _P
        ups = [up]
        while len(ups[-1].ups) >= len(ups):
            ups.append(ups[-1].ups[len(ups) - 1])
        self.ups = tuple(ups)

    def back(self, depth: int) -> Node:
        at = self
        while at.depth > depth:
            at = at.ups[(at.depth - depth).bit_length() - 1]
        return at

    def pieces(self) -> list[str]:
        found, at = [], self
        while at.depth:
            found.append(at.piece)
            at = at.ups[0]
        return found[::-1]


def _same(a: Node, b: Node) -> bool:
    """Hashes tell most prefixes apart; where they don't, the nodes do."""
    return a.hash == b.hash and a is b


def less(a: Node, b: Node) -> bool:
    """Whether audit a comes before audit b: by the first piece after their longest common prefix."""
    depth = min(a.depth, b.depth)
    x, y = a.back(depth), b.back(depth)
    if _same(x, y):
        return a.depth < b.depth
    for k in range(len(x.ups) - 1, -1, -1):
        if k < len(x.ups) and not _same(x.ups[k], y.ups[k]):
            x, y = x.ups[k], y.ups[k]
    return x.piece < y.piece


#: Cost and audit of each state. J is the K of a row that begins with s: no row could have both, so the order of audits is the same.
Best = list[tuple[int, Node] | None]


def _offer(best: Best, state: int, cost: int, up: Node, piece: str) -> bool:
    held = best[state]
    if held is None or cost < held[0]:
        best[state] = cost, Node(up, piece)
    elif cost == held[0] and less(node := Node(up, piece), held[1]):
        best[state] = cost, node
    else:
        return False
    return True


def inserted(best: Best) -> Best:
    """With rows inserted after what there is."""
    best = list(best)
    again = True
    while again:
        again = False
        for state, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if (held := best[state]) is not None:
                again |= _offer(best, to, held[0] + 5, held[1], "I")
    return best


def stepped(best: Best, initial: str, fault: int) -> Best:
    """With the next row of the conversation."""
    before, after = inserted(best), [None] * 4
    for state, held in enumerate(before):
        if held is None:
            continue
        cost, node = held
        _offer(after, state, cost + 2, node, "D")
        if fault not in (BLANK, DUPLICATE):
            cost += 5 * (fault == TRUNCATED)
            if initial in _AFTER and state in _AFTER[initial][1]:
                _offer(after, _AFTER[initial][0], cost, node, "J" if initial == "s" else "K")
            _offer(after, 3 if state == 2 else 2, cost + 1, node, "R")
    return after


def _from(state: int) -> Best:
    best: Best = [None] * 4
    best[state] = 0, Node()
    return best


def composed(best: Best, costs: list[int | None], audits: list[str | None]) -> Best:
    """With a segment, given by its cost and audit from each state (row) to each (column)."""
    after: Best = [None] * 4
    for state, held in enumerate(best):
        for to in range(4):
            if held is not None and (cost := costs[4 * state + to]) is not None:
                _offer(after, to, held[0] + cost, held[1], audits[4 * state + to])
    return after


def finished(best: Best) -> tuple[int, list[str]]:
    """Cost and pieces of the cheapest audit."""
    best = inserted(best)
    ends = [best[k] for k in (0, 3) if best[k] is not None]
    one = ends[0]
    for other in ends[1:]:
        if other[0] < one[0] or other[0] == one[0] and less(other[1], one[1]):
            one = other
    return one[0], one[1].pieces()


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _segments(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, rows, first, last, illegal, costs, audits) of rows (conv_id, segment, at, initial, fault)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []

        def opened(segment: int) -> None:
            nonlocal starts, n, illegal
            starts, n, illegal = {s: _from(s) for s in ((0,) if segment == 0 else range(4))}, 0, 0

        def closed() -> None:
            costs, audits = [], []
            for s in range(4):
                for end in starts.get(s, [None] * 4):
                    costs.append(None if end is None else end[0])
                    audits.append(None if end is None else "".join(end[1].pieces()))
            out.append((*key, n, first, last, illegal, costs, audits))

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "rows", "first", "last", "illegal", "costs", "audits"])

        starts, n, illegal, first, last = {}, 0, 0, "", ""
        for b in batches:
            for conv, segment, initial, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "initial", "fault"))):
                if (conv, segment) != key:
                    if key is not None:
                        closed()
                    if len(out) >= 1000:
                        yield batch()
                    key, first = (conv, segment), initial
                    opened(segment)
                elif not _legal(last + initial):
                    illegal += 1
                starts = {s: stepped(best, initial, fault) for s, best in starts.items()}
                n, last = n + 1, initial
        if key is not None:
            closed()
        if out:
            yield batch()

    ship(rows.sparkSession)
    small = rows.select("conv_id", "segment", "at", "initial", "fault")
    return small.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at").mapInArrow(
        run, "conv_id bigint, segment bigint, rows bigint, first string, last string, illegal bigint, costs array<bigint>, audits array<string>"
    )


def _letters(segments: DataFrame) -> DataFrame:
    """Letters of every row, and one row with at -1 for each conversation: (conv_id, at, inserted, letter, role, audit, cost, illegal).

    inserted has the roles of rows that go in before, role is what an R gives. Rows that go in at the end stand at the number of rows."""
    names = ["conv_id", "at", "inserted", "letter", "role", "audit", "cost", "illegal"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def rows_of(conv: int | None, best: Best, illegal: int) -> Iterator[tuple]:
        cost, pieces = finished(best)
        yield conv, -1, None, None, None, "".join(pieces).replace("J", "K"), cost, illegal
        state, at, inserted_ = 0, 0, []
        for letter in (x for piece in pieces for x in piece):
            role = "assistant" if state == 2 else "user"
            if letter == "I":
                inserted_.append(role)
            else:
                yield conv, at, inserted_, letter, role, None, None, None
                at, inserted_ = at + 1, []
            if letter != "D":
                state = 1 if letter == "J" else 3 if state == 2 else 2
        if inserted_:
            yield conv, at, inserted_, None, None, None, None, None

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, best, last, illegal = None, None, "", 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "first", "last", "illegal", "costs", "audits"))):
                if best is None or r[0] != conv:
                    if best is not None:
                        yield from rows_of(conv, best, illegal)
                    conv, best, illegal = r[0], _from(0), 0
                elif not _legal(last + r[1]):
                    illegal += 1
                best, last, illegal = composed(best, r[4], r[5]), r[2], illegal + r[3]
        if best is not None:
            yield from rows_of(conv, best, illegal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batched(all_rows(batches), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names)

    ship(segments.sparkSession)
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(
        run, "conv_id bigint, at bigint, inserted array<string>, letter string, role string, audit string, cost bigint, illegal bigint"
    )


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, role, text, fault) of rows (conv_id, turn, role, text), written: their places and first faults."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), given("role"), given("text"))
    rows = rows.withColumn("known", F.col("turn").isNotNull())
    at = stage(placed(rows, "conv_id", ["known", "turn", "role", "text"]).withColumnRenamed("_at", "at"), "placed")
    wording = F.sha2(F.concat("role", F.lit("\n"), "text"), 256)
    again = at.groupBy("conv_id", "role", wording.alias("wording")).agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = broadcast_if_few(stage(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "wording", "earliest"), "repeats"), 100_000)
    met = at.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (wording == F.col("wording")), "left")
    said = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(said == "", BLANK).when(F.col("at") > F.col("earliest"), DUPLICATE)
        .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    )
    return stage(met.select("conv_id", "at", "turn", "role", "text", fault.alias("fault")), "numbered")


def letters(rows: DataFrame) -> DataFrame:
    """The audit of numbered rows, written."""
    small = rows.select(
        "conv_id", F.floor(F.col("at") / SEGMENT).cast("bigint").alias("segment"), "at", F.left("role", F.lit(1)).alias("initial"), "fault"
    )
    return stage(_letters(stage(_segments(small), "segments")), "letters")


def findings(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of numbered rows and their letters."""
    of = lambda code, name: F.count_if(F.col("fault") == code).alias(name)
    counts = rows.groupBy("conv_id").agg(of(BLANK, "blank"), of(DUPLICATE, "duplicate"), of(TRUNCATED, "truncated"))
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    whole = audit.where("at = -1").select("conv_id", "illegal", "cost", "audit")
    for other in (turns, counts):
        other = other.withColumnRenamed("conv_id", "other")
        whole = whole.join(other, F.col("conv_id").eqNullSafe(F.col("other"))).drop("other")
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, at, part, role, text, edit): the repaired rows of numbered rows and their letters, in the order of (at, part)."""
    item = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))
    each = audit.where("at >= 0").select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "inserted", "letter", F.col("role").alias("given"))
    both = each.join(rows.select("conv_id", "at", "role", "text"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("a") == F.col("at")), "left")
    new = F.transform("inserted", lambda role: item(role, F.lit(""), "I"))
    own = (
        F.when(F.col("letter").isin("J", "K"), F.array(item(F.col("role"), F.col("text"), "K")))
        .when(F.col("letter") == "R", F.array(item(F.col("given"), F.col("text"), "R"))).otherwise(F.slice(new, 1, 0))
    )
    return both.select(F.col("c").alias("conv_id"), F.col("a").alias("at"), F.posexplode(F.concat(new, own)).alias("part", "i")).select(
        "conv_id", "at", "part", "i.*"
    )


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows: their `role:text` joined by line ends, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv = None, None
        done: list[tuple] = []
        for b in batches:
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if held is None or c != conv:
                    if held is not None:
                        done.append((conv, held.hexdigest()))
                    held, conv = hashlib.sha256(), c
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])
            done.clear()
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([held.hexdigest()])], ["conv_id", "repaired_sha256"])

    ship(rows.sparkSession)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings for each conversation, and the repaired rows."""
    at = numbered(rows)
    audit = letters(at)
    return findings(at, audit), repaired(at, audit)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as the query damages them, by crc32(`conv_id:turn`) % 20: 0 drops one, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4
    makes its role user. What is null is one space, but conv_id and turn stay null as keys."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text, role = given("text"), given("role")
    each = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).where("code != 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times: Column = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return each.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_again")).drop("_again")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found, rows = repair_conversations(damaged(given))
    ids = given.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    sums = digests(rows)
    both = ids
    for other in (found, sums):
        other = other.withColumnRenamed("conv_id", "other")
        both = both.join(other, F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


SQL = {
    "op12_conversation_repair": r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
coded AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295::BIGINT) % 20 AS code
  FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded JOIN (VALUES (1), (2)) t(copy) ON code <> 0 AND (copy = 1 OR code = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, E' \t\n\x0B\f\r') AS said,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS seen,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY place), 1) || left(role, 1) AS pair
  FROM placed),
judged AS (
  SELECT *, CASE WHEN said = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM faulty),
steps AS (
  SELECT conv_id, 0::BIGINT AS place, {c: 0, a: '', r: ''} AS s0, {c: 1000000, a: '', r: ''} AS s1, {c: 1000000, a: '', r: ''} AS s2, {c: 1000000, a: '', r: ''} AS s3
  FROM (SELECT DISTINCT conv_id FROM judged)
  UNION ALL
  SELECT conv_id, place,
    {c: s0.c + 2, a: s0.a || 'D', r: s0.r},
    least({c: s1.c + 2, a: s1.a || 'D', r: s1.r}, {c: s0.c + CASE WHEN initial = 's' THEN own ELSE 1000000 END, a: s0.a || 'K', r: s0.r || kept}),
    least({c: u.c + 2, a: u.a || 'D', r: u.r},
          {c: s0.c + keep_u, a: s0.a || 'K', r: s0.r || kept}, {c: s1.c + keep_u, a: s1.a || 'K', r: s1.r || kept}, {c: b.c + keep_u, a: b.a || 'K', r: b.r || kept},
          {c: s0.c + own + 1, a: s0.a || 'R', r: s0.r || as_user}, {c: s1.c + own + 1, a: s1.a || 'R', r: s1.r || as_user}, {c: b.c + own + 1, a: b.a || 'R', r: b.r || as_user}),
    least({c: b.c + 2, a: b.a || 'D', r: b.r}, {c: u.c + CASE WHEN initial = 'a' THEN own ELSE 1000000 END, a: u.a || 'K', r: u.r || kept},
          {c: u.c + own + 1, a: u.a || 'R', r: u.r || as_assistant})
  FROM (SELECT j.*, s.s0, s.s1, s.u, least(s.s3, {c: s.u.c + 5, a: s.u.a || 'I', r: s.u.r || E'\nassistant:'}) AS b,
               CASE WHEN fault IN (1, 2) THEN 1000000 WHEN fault = 3 THEN 5 ELSE 0 END AS own,
               CASE WHEN initial = 'u' THEN CASE WHEN fault IN (1, 2) THEN 1000000 WHEN fault = 3 THEN 5 ELSE 0 END ELSE 1000000 END AS keep_u,
               E'\n' || role || ':' || text AS kept, E'\nuser:' || text AS as_user, E'\nassistant:' || text AS as_assistant
        FROM (SELECT *, least(s2, {c: s0.c + 5, a: s0.a || 'I', r: s0.r || E'\nuser:'}, {c: s1.c + 5, a: s1.a || 'I', r: s1.r || E'\nuser:'},
                              {c: s3.c + 5, a: s3.a || 'I', r: s3.r || E'\nuser:'}) AS u FROM steps) s
        JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.place = s.place + 1)),
ends AS (
  SELECT conv_id, least(s0, s3, {c: least(s2, {c: s1.c + 5, a: s1.a || 'I', r: s1.r || E'\nuser:'}).c + 5,
                                 a: least(s2, {c: s1.c + 5, a: s1.a || 'I', r: s1.r || E'\nuser:'}).a || 'I',
                                 r: least(s2, {c: s1.c + 5, a: s1.a || 'I', r: s1.r || E'\nuser:'}).r || E'\nassistant:'}) AS best
  FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
         count_if(fault = 3) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT g.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost,
       coalesce(e.best.a, '') AS audit, sha256(substr(coalesce(e.best.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""
}
