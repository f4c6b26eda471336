"""Structure repair of conversations by a fold over their turns (DataFrame and SQL functions only).

Windows over each conversation number its rows and flag their faults: blank, duplicate (role
and text of an earlier row), truncated. The rows are then collected in order, and one
``aggregate()`` carries four states: nothing emitted, a system turn, a user turn, an assistant
turn came last. A state is the cheapest (cost, audit) struct that leads there, the audit the
initials of the edits so far; ``least`` over structs takes the cheaper one and of equal costs
the least audit. Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty
user or assistant turn 5, and a truncated row that stays 5 more; blank and duplicate rows
have to go. What is left is empty or ``s?(ua)+`` by the initials of the roles. Two inserts at
one place never pay (no state is reached by them that a dearer one needs), so a step tries one.

The audit alone tells the repaired turns: after a leading system turn that was kept, roles
alternate, so the place of an edit gives its role and its row.

Everything after the windows' shuffle stays in its partition. A conversation is one array and
one audit string, as long as it has turns: its rows have to fit a task, and n turns cost some
n squared bytes of string copies (a hundred thousand turns: seconds).

Defined cases: null roles and texts are one space; null turns come first and count for no
gap; a null conversation is one of its own; rows that share a turn go by role, then text;
rows given twice are duplicates; a role that begins with no ``s``, ``u`` or ``a`` is never
kept; further columns are ignored, whatever their names; an empty input gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
#: More than any conversation costs: the price of a state that nothing reaches.
NEVER = 1 << 40


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, here): rows damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays with ``here`` false, so that its conversation does), 1 empties
    the text, 2 removes its sentence ends, 3 repeats the row, 4 makes it a user's.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("kind")
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") != 0).alias("here"))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, here) with place, first fault and the flags of their neighbours."""
    one = Window.partitionBy("conv_id").orderBy(F.desc("here"), F.asc_nulls_first("turn"), "role", "text", "copy")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    before = F.lag("role").over(one)
    out = rows.withColumn("place", F.row_number().over(one)).withColumns({
        "illegal": (F.col("place") > 1) & ~F.concat(F.substring(before, 1, 1), F.substring("role", 1, 1)).isin("su", "ua", "au"),
        "new_turn": F.col("turn").isNotNull() & ((F.col("place") == 1) | ~F.col("turn").eqNullSafe(F.lag("turn").over(one))),
    })
    out = out.withColumn("again", F.row_number().over(same) > 1)
    words = F.rtrim("text", F.lit(SPACE))
    fault = F.when(words == "", "blank").when(F.col("again"), "duplicate").when(~F.right(words, F.lit(1)).isin(".", "!", "?"), "truncated")
    return out.withColumn("fault", fault).drop("again")


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _more(state: Column, cost, letter) -> Column:
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return _state(state["cost"] + cost, F.concat(state["audit"], letter))


def _inserted(states: Column) -> Column:
    """The states with the ways that insert one turn here."""
    e, s, u, a = (states[k] for k in "esua")
    into_user = F.least(u, _more(F.least(e, s, a), 5, "I"))
    return F.struct(e.alias("e"), s.alias("s"), into_user.alias("u"), F.least(a, _more(u, 5, "I")).alias("a"))


def _taken(states: Column, row: Column) -> Column:
    """The states after a row, whose initial is ``row.initial``; it has to go if ``row.must``."""
    e, s, u, a = (states[k] for k in "esua")

    def kept(came: Column, initial: str) -> Column:
        right = row["initial"] == initial
        return F.when(row["must"], F.lit(None)).otherwise(_more(came, F.when(right, 0).otherwise(1) + row["extra"], F.when(right, "K").otherwise("R")))

    system = F.when(~row["must"] & (row["initial"] == "s"), _more(e, row["extra"], "K"))
    return F.struct(
        _more(e, 2, "D").alias("e"),
        F.least(_more(s, 2, "D"), system).alias("s"),
        F.least(_more(u, 2, "D"), kept(F.least(e, s, a), "u")).alias("u"),
        F.least(_more(a, 2, "D"), kept(u, "a")).alias("a"),
    )


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest repair of an array of (role, text, fault) structs."""
    rows = F.transform(
        turns,
        lambda t: F.struct(
            F.substring(t["role"], 1, 1).alias("initial"),
            F.coalesce(t["fault"].isin("blank", "duplicate"), F.lit(False)).alias("must"),
            F.when(t["fault"] == "truncated", 5).otherwise(0).alias("extra"),
        ),
    )
    first, none = _state(F.lit(0), F.lit("")), _state(F.lit(NEVER), F.lit(""))
    start = F.struct(first.alias("e"), none.alias("s"), none.alias("u"), none.alias("a"))

    def step(states, row):  # the inner transform binds the states once
        return F.transform(F.array(_inserted(states)), lambda x: _taken(x, row))[0]

    return F.aggregate(rows, start, step, lambda states: F.least(states["e"], _inserted(states)["a"]))


def repaired(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that an audit makes of an array of (role, text, ..) structs."""
    no_delete = F.length(F.regexp_extract(audit, "^D*", 0)) + 1  # place of the first edit that emits
    system = F.coalesce((F.substring(audit, no_delete, 1) == "K") & F.get(turns, no_delete - 1)["role"].startswith("s"), F.lit(False))

    def turn(letter: Column, k: Column) -> Column:
        head = F.substring(audit, F.lit(1), k)
        emitted = F.length(F.translate(head, "D", "")) - F.when(system, 1).otherwise(0)
        row = F.get(turns, k - (F.length(head) - F.length(F.translate(head, "I", ""))))
        role = F.when(letter == "K", row["role"]).otherwise(F.when(emitted % 2 == 0, "user").otherwise("assistant"))
        text = F.when(letter == "I", "").otherwise(row["text"])
        return F.when(letter != "D", F.struct(role.alias("role"), text.alias("text")))

    letters = F.filter(F.split(audit, ""), lambda c: c != "")
    return F.array_compact(F.transform(letters, turn))


def repair(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text and, if given, copy, here) with their faults and cheapest repair.

    -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), the last an
    array of (role, text). Rows whose ``here`` is false only name their conversation.
    """
    plain = {"copy": F.lit(1), "here": F.lit(True)}
    rows = rows.withColumns({c: v for c, v in plain.items() if c not in rows.columns})
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copy", "here")
    here = F.col("here")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(here & condition, 1).otherwise(0)), F.lit(0)).cast("long")

    turn = F.when(here, F.col("turn"))
    grouped = flagged(rows).groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.sum(F.when(here & F.col("new_turn"), 1).otherwise(0)), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.col("fault").eqNullSafe(f)).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(here, F.struct("place", "role", "text", "fault")))).alias("turns"),
    )
    best = grouped.withColumn("best", cheapest(F.col("turns")))
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", repaired(F.col("turns"), F.col("best.audit")).alias("repaired"))


def op13_conversation_repair(spark, sf_dir):
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repair(rows).withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


_LINE = """CASE substr(audit, i, 1) WHEN 'K' THEN role || ':' || text WHEN 'R' THEN who || ':' || text WHEN 'I' THEN who || ':' END"""
OP13_SQL = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda c:
      list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda b: ((ascii(c) >> b) & 1)::BIGINT)))), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)))) % 20 AS d FROM src),
  dam AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE d WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc),
  pos AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS was FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
  flag AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS cut, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth FROM pos),
  fault AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN cut = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f FROM flag),
  row_ AS (SELECT *, f IN ('blank', 'duplicate') AS must, CASE f WHEN 'truncated' THEN 5 ELSE 0 END AS x FROM fault),
  ids AS (SELECT DISTINCT conv_id FROM conversations),
  st AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 't': ''}} AS e, {{'c': 1099511627776, 't': ''}} AS s, {{'c': 1099511627776, 't': ''}} AS u, {{'c': 1099511627776, 't': ''}} AS a FROM ids
    UNION ALL
    SELECT conv_id, k, {{'c': e.c + 2, 't': e.t || 'D'}},
      CASE WHEN NOT must AND r = 's' THEN least({{'c': s.c + 2, 't': s.t || 'D'}}, {{'c': e.c + x, 't': e.t || 'K'}}) ELSE {{'c': s.c + 2, 't': s.t || 'D'}} END,
      CASE WHEN must THEN {{'c': u2.c + 2, 't': u2.t || 'D'}} ELSE least({{'c': u2.c + 2, 't': u2.t || 'D'}}, {{'c': b.c + x + CASE r WHEN 'u' THEN 0 ELSE 1 END, 't': b.t || CASE r WHEN 'u' THEN 'K' ELSE 'R' END}}) END,
      CASE WHEN must THEN {{'c': a2.c + 2, 't': a2.t || 'D'}} ELSE least({{'c': a2.c + 2, 't': a2.t || 'D'}}, {{'c': u2.c + x + CASE r WHEN 'a' THEN 0 ELSE 1 END, 't': u2.t || CASE r WHEN 'a' THEN 'K' ELSE 'R' END}}) END
    FROM (SELECT *, least(e, s, a2) AS b FROM (SELECT st.conv_id, p.k, p.r, p.must, p.x, st.e, st.s,
        least(st.u, {{'c': least(st.e, st.s, st.a).c + 5, 't': least(st.e, st.s, st.a).t || 'I'}}) AS u2, least(st.a, {{'c': st.u.c + 5, 't': st.u.t || 'I'}}) AS a2
      FROM st JOIN row_ p ON p.conv_id IS NOT DISTINCT FROM st.conv_id AND p.k = st.k + 1))),
  best AS (SELECT conv_id, least(e, a, {{'c': u.c + 5, 't': u.t || 'I'}}) AS b FROM st QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
  sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE f = 'blank') AS blank, count(*) FILTER (WHERE f = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE f = 'truncated') AS truncated, count(*) FILTER (WHERE k > 1 AND substr(was, 1, 1) || r NOT IN ('su', 'ua', 'au')) AS illegal FROM row_ GROUP BY conv_id),
  edit AS (SELECT conv_id, b.t AS audit, unnest(range(1, length(b.t) + 1)) AS i FROM best),
  edits AS (SELECT *, length(replace(substr(audit, 1, i), 'I', '')) AS k, length(replace(substr(audit, 1, i), 'D', '')) AS n, length(regexp_extract(audit, '^D*')) + 1 AS head FROM edit),
  placed AS (SELECT e.conv_id, e.audit, e.i, p.role, p.text, CASE WHEN (n - CASE WHEN substr(audit, head::INTEGER, 1) = 'K' AND q.r = 's' THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END AS who
    FROM edits e LEFT JOIN row_ p ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.k = e.k LEFT JOIN row_ q ON q.conv_id IS NOT DISTINCT FROM e.conv_id AND q.k = e.head),
  text_ AS (SELECT conv_id, string_agg({_LINE}, chr(10) ORDER BY i) AS whole FROM placed GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.b.c AS cost, b.b.t AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN text_ t ON t.conv_id IS NOT DISTINCT FROM b.conv_id"""
