"""Quotation linking: conversations in reply order, without the text that they quote.

Lines that begin with ">" are quoted, as deep as they have such marks; a run of lines of one depth is a passage. A passage,
and each of its lines, is normalised (lower case, single blanks, trimmed) and hashed; so are every message without its
quotes and each of its lines. Within a conversation the hashes join: a message replies to the message whose text it quotes
best - whole passages before single lines, then the larger number of them, then the later message - and without a
match to the turn before it. Conversations come in depth-first reply order. Only heads of threads, where a reply isn't to the turn
before, are followed to their roots and placed in the order; the other messages count on from them.

Everything is DataFrame operations. Joins go by (conversation, hash) and (conversation, turn). Every earlier message that
holds a quoted hash is counted; a hash that more than HOLDERS messages of a conversation hold is salted, so that a phrase
that all use meets in no one task. The pairs of quoting and holding messages of such a phrase are all counted.

Defined results: a null text is empty; a message of quotes only has an empty text; a null role passes through; rows that
repeat conv_id and turn are one message, the smallest text standing for it; a turn whose predecessor is missing is a root;
rows with a null conv_id or turn are roots each, without a position, and link with nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_few, let, stage, table

QUOTE = r"^((?:[ \t]{0,3}>)+)[ ]?"
MIN_UNIT_CHARS = 8
#: Messages that hold a hash, to a salt; turns that are ordered in one task; stands for no turn.
HOLDERS, SPAN, NO_TURN = 1000, 4096, -(1 << 62)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _parsed(text: Column) -> Column:
    """Struct of own text and quoted passages, (depth, text) each."""

    def of_lines(lines: Column) -> Column:
        own = F.array_join(F.transform(F.filter(lines, lambda x: x["depth"] == 0), lambda x: x["body"]), "\n")
        turns = F.filter(
            F.transform(lines, lambda x, i: F.when((i == 0) | (F.get(lines, i - 1)["depth"] != x["depth"]), i)), lambda i: i.isNotNull()
        )

        def passage(starts: Column) -> Column:
            runs = F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(lines, at)["depth"].alias("depth"),
                    F.slice(lines, at + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - at).alias("run"),
                ),
            )
            return F.transform(
                F.filter(runs, lambda r: r["depth"] > 0),
                lambda r: F.struct(r["depth"].alias("depth"), F.array_join(F.transform(r["run"], lambda x: x["body"]), "\n").alias("text")),
            )

        return F.struct(F.btrim(own, F.lit(" \t\r\n")).alias("own"), let(turns, passage).alias("passages"))

    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", "")).alias("depth"),
            F.regexp_replace(x, QUOTE, "").alias("body"),
        ),
    )
    return let(lines, of_lines)


def _units(text: Column) -> Column:
    """Hashes of a text and of its lines: (hash, whole)."""
    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: F.length(x) >= MIN_UNIT_CHARS)
    each = F.transform(lines, lambda x: F.struct(F.sha2(x, 256).alias("hash"), F.lit(False).alias("whole")))
    whole = normalised(text)
    return F.when(whole == "", each).otherwise(
        F.concat(F.array(F.struct(F.sha2(whole, 256).alias("hash"), F.lit(True).alias("whole"))), each)
    )


def _replies(m: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of messages (conv_id, turn, text, passages)."""
    quotes = m.select("conv_id", "turn", F.posexplode("passages").alias("passage", "q")).select(
        "conv_id", "turn", "passage", F.explode(_units(F.col("q.text"))).alias("u")
    )
    quotes = stage(quotes.select("conv_id", "turn", "passage", "u.hash", "u.whole"), "quoted-units")
    asked = quotes.select("conv_id", "hash").distinct()
    held = (
        m.select("conv_id", F.col("turn").alias("origin"), F.explode(_units(F.col("text"))).alias("u"))
        .select("conv_id", "origin", "u.hash")
        .join(broadcast_if_few(asked), ["conv_id", "hash"], "left_semi")
        .distinct()
    )
    held = stage(held, "holders")
    sizes = held.groupBy("conv_id", "hash").agg(
        F.min("origin").alias("first"), F.ceil(F.count(F.lit(1)) / HOLDERS).cast("int").alias("salts")
    )
    sizes = stage(sizes, "holder-counts")
    found = quotes.join(sizes, ["conv_id", "hash"]).where("first < turn")
    n_linked = found.groupBy("conv_id", "turn").agg(F.size(F.collect_set("passage")).cast("bigint").alias("n_linked"))
    salted = held.join(sizes, ["conv_id", "hash"]).withColumn("salt", F.pmod(F.xxhash64("origin"), F.col("salts")).cast("int"))
    hits = (
        found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("conv_id", "hash", "salt", "turn", "whole")
        .join(salted.select("conv_id", "hash", "salt", "origin"), ["conv_id", "hash", "salt"])
        .where("origin < turn")
    )
    per_origin = hits.groupBy("conv_id", "turn", "origin").agg(
        F.count_if("whole").alias("n_whole"), F.count(F.lit(1)).alias("n_units")
    )
    best = F.max(F.struct("n_whole", "n_units", "origin"))["origin"].alias("quoted_turn")
    linked = stage(per_origin.groupBy("conv_id", "turn").agg(best).join(n_linked, ["conv_id", "turn"]), "linked")
    before = m.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    return (
        m.select("conv_id", "turn").join(before, ["conv_id", "turn"], "left").join(broadcast_if_few(linked), ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", F.coalesce("quoted_turn", "previous").alias("reply_to"),
            F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"),
        )
    )


def _following(rows: DataFrame, keys: list[str], at: str, descending: bool = False) -> DataFrame:
    """Adds `following`: the next value of `at` among rows with equal keys, null for the last. Keys aren't null, (keys, at) is unique.

    Rows are ordered within blocks of SPAN values, and then the blocks, so that no task sorts a whole group."""
    order = F.col(at).desc() if descending else F.col(at).asc()
    block = F.floor(F.col(at) / SPAN)
    rows = rows.withColumn("block", block)
    inside = rows.withColumn("following", F.lead(at).over(Window.partitionBy(*keys, "block").orderBy(order)))
    ends = rows.groupBy(*keys, "block").agg((F.max(at) if descending else F.min(at)).alias("first"))
    blocks = F.col("block").desc() if descending else F.col("block").asc()
    ends = ends.withColumn("after", F.lead("first").over(Window.partitionBy(*keys).orderBy(blocks))).drop("first")
    return inside.join(ends, [*keys, "block"]).withColumn("following", F.coalesce("following", "after")).drop("after", "block")


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, head) of replies (conv_id, turn, reply_to). A thread is a run of turns of which each but the first,
    its head, replies to the one before."""
    starts = F.when(F.col("reply_to").isNull() | (F.col("reply_to") != F.col("turn") - 1), F.col("turn"))
    rows = replies.select("conv_id", "turn", "reply_to", starts.alias("start"), F.floor(F.col("turn") / SPAN).alias("block"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("conv_id", "block").agg(F.max("start").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.max("last").over(earlier)).drop("last").where("carried IS NOT NULL")
    return (
        rows.withColumn("head", F.max("start").over(so_far)).join(blocks, ["conv_id", "block"], "left")
        .select("conv_id", "turn", "reply_to", F.coalesce("head", "carried").alias("head"))
    )


def _tree(threads: DataFrame) -> DataFrame:
    """(conv_id, head, length, root_turn, depth, position) of the threads' heads.

    In depth-first order a thread is one run, followed by what replies to its last message, then to the one before, and so on. So only
    heads are walked: upwards for roots and depths, and along the order for positions, by doubling; what has arrived
    doesn't travel again.
    """
    grouped = threads.groupBy("conv_id", "head").agg(
        F.count(F.lit(1)).alias("length"), F.max(F.when(F.col("turn") == F.col("head"), F.col("reply_to"))).alias("reply_to")
    )
    heads = stage(grouped, "threads")
    above = threads.select("conv_id", F.col("turn").alias("reply_to"), F.col("head").alias("parent"))
    hung = stage(heads.where("reply_to IS NOT NULL").join(above, ["conv_id", "reply_to"]), "hung")
    roots = heads.where("reply_to IS NULL").select("conv_id", "head", F.col("head").alias("root_turn"), F.lit(0).cast("bigint").alias("depth"))
    done = roots
    # up: every round doubles the steps taken
    open_ = hung.select("conv_id", "head", F.col("parent").alias("at"), (F.col("reply_to") - F.col("parent") + 1).alias("steps"))
    while not open_.isEmpty():
        far = done.select("conv_id", F.col("head").alias("at"), "root_turn", "depth", F.lit(None).cast("bigint").alias("next"), F.lit(None).cast("bigint").alias("more"))
        near = open_.select("conv_id", F.col("head").alias("at"), F.lit(None).cast("bigint").alias("root_turn"), F.lit(None).cast("bigint").alias("depth"), F.col("at").alias("next"), F.col("steps").alias("more"))
        moved = stage(open_.join(far.unionByName(near), ["conv_id", "at"]), "up")
        arrived = moved.where("root_turn IS NOT NULL").select("conv_id", "head", "root_turn", (F.col("steps") + F.col("depth")).alias("depth"))
        done = stage(done.unionByName(arrived), "arrived")
        open_ = moved.where("root_turn IS NULL").select("conv_id", "head", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"))
    # along the order: a walk enters and leaves each thread; conversations of one thread need none
    several = heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"), F.sum("length").alias("total")).where("k > 1")
    nodes = stage(
        heads.join(several, "conv_id").join(hung.select("conv_id", "head", "parent"), ["conv_id", "head"], "left")
        .select("conv_id", "head", "length", "total", F.coalesce("reply_to", F.lit(NO_TURN)).alias("under"), F.coalesce("parent", F.lit(NO_TURN)).alias("parent")),
        "nodes",
    )
    beside = _following(nodes, ["conv_id", "under"], "head").withColumnRenamed("following", "sibling")
    firsts = nodes.groupBy("conv_id", "parent", "under").agg(F.min("head").alias("child"))
    lower = _following(firsts.select("conv_id", "parent", "under"), ["conv_id", "parent"], "under", descending=True)
    lower = lower.join(firsts.select("conv_id", "under", F.col("child").alias("cousin")).withColumnRenamed("under", "following"), ["conv_id", "following"], "left")
    top = firsts.groupBy("conv_id", "parent").agg(F.max(F.struct("under", "child"))["child"].alias("child"))
    t = (
        beside.join(lower.select("conv_id", "under", "cousin"), ["conv_id", "under"], "left")
        .withColumn("beside", F.coalesce("sibling", "cousin"))
        .join(top.where(F.col("parent") != NO_TURN).select("conv_id", F.col("parent").alias("head"), "child"), ["conv_id", "head"], "left")
    )
    parent = F.nullif(F.col("parent"), F.lit(NO_TURN))
    into = t.select("conv_id", "head", F.lit(False).alias("up"), F.coalesce("child", "head").alias("next"), F.col("child").isNull().alias("next_up"), F.col("length").alias("n"))
    out = t.select("conv_id", "head", F.lit(True).alias("up"), F.coalesce("beside", parent).alias("next"), F.col("beside").isNull().alias("next_up"), F.lit(0).cast("bigint").alias("n"))
    walk = stage(into.unionByName(out), "walk")
    ended, going = walk.where("next IS NULL"), walk.where("next IS NOT NULL")
    while not going.isEmpty():
        jump = ended.unionByName(going).select(
            "conv_id", F.col("head").alias("next"), F.col("up").alias("next_up"), F.col("next").alias("after"), F.col("next_up").alias("after_up"), F.col("n").alias("more")
        )
        moved = stage(
            going.join(jump, ["conv_id", "next", "next_up"])
            .select("conv_id", "head", "up", F.col("after").alias("next"), F.col("after_up").alias("next_up"), (F.col("n") + F.col("more")).alias("n")),
            "walk",
        )
        ended = stage(ended.unionByName(moved.where("next IS NULL")), "ended")
        going = moved.where("next IS NOT NULL")
    # n: messages from here to the end of the conversation
    place = nodes.select("conv_id", "head", "total").join(ended.where("NOT up").select("conv_id", "head", "n"), ["conv_id", "head"])
    place = place.select("conv_id", "head", (F.col("total") - F.col("n")).alias("position"))
    return (
        heads.select("conv_id", "head").join(done, ["conv_id", "head"]).join(place, ["conv_id", "head"], "left")
        .withColumn("position", F.coalesce("position", F.lit(0).cast("bigint")))
    )


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, root_turn, depth, position, n_passages, n_linked, text), one row for each message.

    Sorted by position, a conversation is in depth-first reply order: every message before its replies, these by turn, and roots by turn.
    """
    rows = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    unknown = F.col("conv_id").isNull() | F.col("turn").isNull()
    one = rows.where(~unknown).groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    parsed = lambda d: d.select("conv_id", "turn", "role", _parsed(F.col("text")).alias("p")).select("conv_id", "turn", "role", F.col("p.own").alias("text"), F.col("p.passages").alias("passages"))
    m = stage(parsed(one), "messages")
    replies = stage(_replies(m), "replies")
    threads = stage(_threads(replies), "of-threads")
    tree = stage(_tree(threads), "tree")
    offset = F.col("turn") - F.col("head")
    found = (
        m.join(replies, ["conv_id", "turn"]).join(threads.select("conv_id", "turn", "head"), ["conv_id", "turn"]).join(tree, ["conv_id", "head"])
        .select(
            "conv_id", "turn", "role", "reply_to", "root_turn", (F.col("depth") + offset).alias("depth"), (F.col("position") + offset).alias("position"),
            F.size("passages").cast("bigint").alias("n_passages"), "n_linked", "text",
        )
    )
    none = F.lit(None).cast("bigint")
    alone = parsed(rows.where(unknown)).select(
        "conv_id", "turn", "role", none.alias("reply_to"), F.col("turn").alias("root_turn"), F.lit(0).cast("bigint").alias("depth"),
        none.alias("position"), F.size("passages").cast("bigint").alias("n_passages"), F.lit(0).cast("bigint").alias("n_linked"), "text",
    )
    return found.unionByName(alone)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


SQL = {
    "op3_chat_formatting": r"""
WITH RECURSIVE m0 AS (
  SELECT conv_id, turn, min(struct_pack(t := coalesce(text, ''), r := role)) AS m FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
l AS (
  SELECT conv_id, turn, i, ln, regexp_extract(ln, '^((?:[ \t]{0,3}>)+)[ ]?', 1) AS q
  FROM (SELECT conv_id, turn, unnest(string_split(m.t, chr(10))) AS ln, generate_subscripts(string_split(m.t, chr(10)), 1) AS i FROM m0)),
b AS (SELECT conv_id, turn, i, length(regexp_replace(q, '[^>]', '', 'g')) AS d, regexp_replace(ln, '^((?:[ \t]{0,3}>)+)[ ]?', '') AS body FROM l),
own AS (
  SELECT conv_id, turn, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (d = 0), ''), ' ' || chr(9) || chr(13) || chr(10)) AS text
  FROM b GROUP BY ALL),
runs AS (
  SELECT *, sum(CASE WHEN d = p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run
  FROM (SELECT *, lag(d) OVER (PARTITION BY conv_id, turn ORDER BY i) AS p FROM b)),
pas AS (SELECT conv_id, turn, run, string_agg(body, chr(10) ORDER BY i) AS t FROM runs WHERE d > 0 GROUP BY ALL),
txt AS (
  SELECT 'q' AS k, conv_id, turn, run, t FROM pas
  UNION ALL SELECT 'o', conv_id, turn, 0, text FROM own),
u AS (
  SELECT k, conv_id, turn, run, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS n, true AS whole FROM txt
  UNION ALL
  SELECT k, conv_id, turn, run, n, false FROM (
    SELECT k, conv_id, turn, run, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS n
    FROM (SELECT k, conv_id, turn, run, unnest(string_split(t, chr(10))) AS x FROM txt)) WHERE length(n) >= 8),
held AS (SELECT DISTINCT conv_id, n, turn AS origin FROM u WHERE k = 'o' AND n <> ''),
hits AS (SELECT q.conv_id, q.turn, run, whole, origin FROM u q JOIN held h ON h.conv_id = q.conv_id AND h.n = q.n WHERE q.k = 'q' AND q.n <> '' AND origin < q.turn),
per AS (SELECT conv_id, turn, origin, count(*) FILTER (whole) AS nw, count(*) AS nu FROM hits GROUP BY ALL),
lk AS (
  SELECT conv_id, turn, max(struct_pack(a := nw, b := nu, c := origin)).c AS quoted,
         (SELECT count(DISTINCT run) FROM hits h WHERE h.conv_id = per.conv_id AND h.turn = per.turn) AS n_linked
  FROM per GROUP BY ALL),
rep AS (
  SELECT m0.conv_id, m0.turn, m0.m.r AS role, own.text, coalesce(lk.quoted, p.turn) AS reply_to,
         (SELECT count(*) FROM pas WHERE pas.conv_id = m0.conv_id AND pas.turn = m0.turn) AS n_passages,
         coalesce(lk.n_linked, 0) AS n_linked
  FROM m0 JOIN own USING (conv_id, turn) LEFT JOIN lk USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn FROM m0) p ON p.conv_id = m0.conv_id AND p.turn = m0.turn - 1),
tree AS (
  SELECT conv_id, turn, turn AS root_turn, CAST(0 AS BIGINT) AS depth, [turn] AS path FROM rep WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, t.root_turn, t.depth + 1, list_append(t.path, r.turn) FROM tree t JOIN rep r ON r.conv_id = t.conv_id AND r.reply_to = t.turn)
SELECT r.conv_id, r.turn, r.role, r.reply_to, t.root_turn, t.depth,
       row_number() OVER (PARTITION BY r.conv_id ORDER BY t.path) - 1 AS position, r.n_passages, r.n_linked, r.text
FROM rep r JOIN tree t USING (conv_id, turn)"""
}
