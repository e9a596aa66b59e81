"""Conversation structure repair by a survivor-coalescence Viterbi search.

The rows of a conversation, in order of turn, are edited at least cost so that the initials of their roles read ``(s?(ua)+)?``: a row is kept (0), given the other role
(3) or deleted (4; blank and repeated rows must go), rows without text are inserted (3), and a truncated row that stays costs 3 more. Of equally cheap audits (initials of the edits in
order: D, I, K, R) the least one counts.

The search holds, for each of four states (nothing yet, after s, after u, after a), the cheapest audit that ends there: a leaf of a backpointer tree whose nodes know who still refers to
them. A node that nobody refers to goes, and once all survivors share an ancestor, the edits up to it are final: they are emitted, and their rows are forgotten. So memory is that of the
unresolved part, whatever the length of the conversation. Two equally cheap ways into a state are compared by their whole unresolved suffixes; none can be the other's beginning, since both have read
the same rows and what one has more would be insertions, which cost. The audit of a state determines its roles, so nothing else can tie.

Spark marks faults by built-in functions, finds repeated rows by a window over (conversation, role, text), and brings each conversation's rows, in order, past a task as a stream; sorting may
spill, and no conversation is collected. The digest of a conversation is one hash over its rows in order, so a conversation is not split among tasks.

Defined results: null roles and texts count as one space; the null conversation is one conversation; null turns come first; rows of one turn stand in order of role, then text; repeated rows each count (the later
ones as duplicates); texts of any length are hashed whole; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm._memory import lean

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"

#: State after a role's initial, by state before: nothing yet, after s, after u, after a. The first and the last may end a conversation.
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The role that a row given another one, or inserted, takes in a state, and the state after it.
_OTHER = [(USER, 2), (USER, 2), (ASSISTANT, 3), (USER, 2)]
_ENDS = (0, 3)
_LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after faults that a checksum of (conversation, turn) puts in: of twenty residues 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"), (F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn))) % 20).alias("_kind"))
    kind = F.col("_kind")
    hurt = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, F.lit(USER)).otherwise(F.col("role")).alias("role"), hurt.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault): blank, duplicate, truncated or null, the first that holds."""
    worded = F.rtrim("text", F.lit(SPACES))
    place = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault: Column = F.when(worded == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~F.right(worded, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]).withColumn("_nth", place).select("conv_id", "turn", "role", "text", fault.alias("fault"), "_nth")


class _Node:
    """An edit after its parent's. It lives as long as a survivor holds it or an edit follows it."""

    __slots__ = ("parent", "children", "held", "edit", "turn", "role", "text")

    def __init__(self, parent: _Node | None, edit: str, turn: int | None, role: str, text: str):
        self.parent, self.children, self.held = parent, [], 0
        self.edit, self.turn, self.role, self.text = edit, turn, role, text
        if parent is not None:
            parent.children.append(self)

    def release(self) -> None:
        """One holder less; what nobody needs goes, up to the first node that is needed."""
        self.held -= 1
        node = self
        while node.parent is not None and not node.held and not node.children:
            parent, node.parent = node.parent, None
            parent.children.remove(node)
            node = parent


def _suffix(node: _Node) -> list[str]:
    """Edits after the last emitted one, in order."""
    out = []
    while node.parent is not None:
        out.append(node.edit)
        node = node.parent
    return out[::-1]


class Repair:
    """The search over one conversation; ``emit`` takes each final edit once, in order: (edit, turn, role, text)."""

    def __init__(self, emit: Callable[[str, int | None, str, str], None]):
        self.emit = emit
        self.root = _Node(None, "", None, "", "")
        self.root.held = 1
        self.best: dict[int, tuple[int, _Node]] = {0: (0, self.root)}
        self._insertions(self.best)

    def _offer(self, found: dict[int, tuple[int, _Node]], state: int, cost: int, parent: _Node, edit: str, turn: int | None, role: str, text: str) -> bool:
        """Whether this way into the state is better than the one found before, which it then replaces."""
        known = found.get(state)
        if known is not None and (cost > known[0] or cost == known[0] and [*_suffix(parent), edit] >= _suffix(known[1])):
            return False
        node = _Node(parent, edit, turn, role, text)
        node.held = 1
        found[state] = cost, node
        if known is not None:
            known[1].release()
        return True

    def _insertions(self, found: dict[int, tuple[int, _Node]]) -> None:
        moved = True
        while moved:
            moved = False
            for state in sorted(found):
                cost, node = found[state]
                role, after = _OTHER[state]
                moved |= self._offer(found, after, cost + INSERT, node, "I", None, role, "")

    def read(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        found: dict[int, tuple[int, _Node]] = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            self._offer(found, state, cost + DELETE, node, "D", turn, role, "")
            if fault in ("blank", "duplicate"):
                continue
            after = _NEXT[state].get(role[:1])
            if after is not None:
                self._offer(found, after, cost + extra, node, "K", turn, role, text)
            other, after = _OTHER[state]
            self._offer(found, after, cost + REROLE + extra, node, "R", turn, other, text)
        self._insertions(found)
        # whatever may follow nothing or an s may follow an a too, but for an s, which is deleted there: dearer survivors can't win or tie any more, and would hold all edits since the beginning
        for state, more in ((0, DELETE), (1, 0)):
            if state in found and 3 in found and found[state][0] > found[3][0] + more:
                found.pop(state)[1].release()
        for _, node in self.best.values():
            node.release()
        self.best = found
        while len(self.root.children) == 1 and not self.root.held:
            self._emit(self.root.children[0])

    def _emit(self, node: _Node) -> None:
        """The node becomes the root: no survivor goes past it any other way."""
        self.emit(node.edit, node.turn, node.role, node.text)
        node.parent, node.text, self.root = None, "", node

    def finish(self) -> int:
        """Emits the rest of the best audit that may end here and returns its cost."""
        cost, _, node = min(((self.best[s][0], _suffix(self.best[s][1]), self.best[s][1]) for s in _ENDS if s in self.best), key=lambda x: x[:2])
        rest = []
        while node.parent is not None:
            rest.append(node)
            node = node.parent
        for node in reversed(rest):
            self._emit(node)
        return cost


_ROW = ["conv_id", "turn", "role", "text", "fault"]


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable, row: Callable, end: Callable, most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows: ``begin(conv_id)`` gives a state, ``row(state, turn, role, text, fault)`` and ``end(state)`` give finished rows of the schema."""
    current, state, out, size = object(), None, [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for part in batches:
        for conv_id, turn, role, text, fault in zip(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in _ROW]):
            if conv_id != current:
                done = end(state) if state is not None else []
                current, state = conv_id, begin(conv_id)
            else:
                done = []
            done = [*done, *row(state, turn, role, text, fault)]
            out += done
            size += len(done) + len(text) // 100
            if size >= most:
                yield batch()
                out, size = [], 0
    if state is not None:
        out += end(state)
    yield batch()


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows with their faults, each conversation in one task and in order."""
    marked = faults(rows)
    return marked.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "_nth").select(*_ROW)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the edited conversations; kept, changed and inserted rows have a place from 1, deleted ones none and no text."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def begin(conv_id):
        state = {"conv": conv_id, "n": 0, "out": []}

        def emit(edit, turn, role, text):
            state["n"] += edit != "D"
            state["out"].append((conv_id, None if edit == "D" else state["n"], edit, turn, role, text))

        state["repair"] = Repair(emit)
        return state

    def taken(state):
        done, state["out"][:] = list(state["out"]), []
        return done

    def row(state, turn, role, text, fault):
        state["repair"].read(turn, role, text, fault)
        return taken(state)

    def end(state):
        state["repair"].finish()
        return taken(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _conversations(batches, begin, row, end, 4096, schema)

    return _in_order(rows).withColumn("conv_id", F.col("conv_id").cast("bigint")).withColumn("turn", F.col("turn").cast("bigint")).mapInArrow(lean(run), "conv_id bigint, place bigint, edit string, turn bigint, role string, text string")


_SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _SUMS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def begin(conv_id):
        state = {"conv": conv_id, "first": None, "last": None, "turns": 0, "before": None, "audit": [], "hash": hashlib.sha256(), "any": False} | dict.fromkeys(_SUMS, 0)

        def emit(edit, turn, role, text):
            state["audit"].append(edit)
            if edit != "D":
                state["hash"].update(("\n" * state["any"] + role + ":" + text).encode())
                state["any"] = True

        state["repair"] = Repair(emit)
        return state

    def row(state, turn, role, text, fault):
        if fault is not None:
            state[fault] += 1
        if turn is not None and turn != state["last"]:
            state["first"] = turn if state["turns"] == 0 else state["first"]
            state["last"], state["turns"] = turn, state["turns"] + 1
        if state["before"] is not None and state["before"] + role[:1] not in _LEGAL:
            state["illegal"] += 1
        state["before"] = role[:1]
        state["repair"].read(turn, role, text, fault)
        return []

    def end(state):
        state["cost"] = state["repair"].finish()
        state["gaps"] = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
        return [(state["conv"], *[state[c] for c in _SUMS], "".join(state["audit"]), state["hash"].hexdigest())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _conversations(batches, begin, row, end, 4096, schema)

    return _in_order(rows).withColumn("conv_id", F.col("conv_id").cast("bigint")).withColumn("turn", F.col("turn").cast("bigint")).mapInArrow(lean(run), "conv_id bigint, " + ", ".join(f"{c} bigint" for c in _SUMS) + ", audit string, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """:func:`audits` of the damaged conversations, with a row for each conversation there was before."""
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    found = audits(damaged(conversations))
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _SUMS], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()])


_BYTES = "list_transform(range(1, strlen(k) + 1), lambda i: ascii(k[i])::BIGINT)"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
_SPACE_SQL = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: (state before, edit, initial that it needs, state after, role that it gives, cost) and (state before, insertions, state after, rows, cost).
_EDITS_SQL = ", ".join([f"({s}, 'D', NULL, {s}, NULL, {DELETE})" for s in range(4)] + [f"({s}, 'K', '{i}', {t}, NULL, 0)" for s in range(4) for i, t in _NEXT[s].items()] + [f"({s}, 'R', NULL, {t}, '{r}', {REROLE})" for s, (r, t) in enumerate(_OTHER)])
_INSERTS_SQL = ", ".join(
    [f"({s}, '', {s}, []::VARCHAR[], 0)" for s in range(4)]
    + [f"({s}, 'I', {t}, ['{r}:'], {INSERT})" for s, (r, t) in enumerate(_OTHER)]
    + [f"({s}, 'II', {_OTHER[t][1]}, ['{r}:', '{_OTHER[t][0]}:'], {2 * INSERT})" for s, (r, t) in enumerate(_OTHER)]
)

SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN '{USER}' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy FROM c, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, {_SPACE_SQL}) AS t FROM d),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
e AS (SELECT * FROM (VALUES {_EDITS_SQL}) AS e(before, edit, needs, after, gives, price)),
ins AS (SELECT * FROM (VALUES {_INSERTS_SQL}) AS s(before, edit, after, added, price)),
v AS (SELECT ids.conv_id, 0::BIGINT AS i, ins.after AS state, struct_pack(cost := ins.price, audit := ins.edit, made := ins.added) AS best FROM (SELECT DISTINCT conv_id FROM f) ids, ins WHERE ins.before = 0
  UNION ALL
  SELECT v.conv_id, v.i + 1, ins.after, min(struct_pack(cost := v.best.cost + e.price + ins.price + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN {TRUNCATED} ELSE 0 END, audit := v.best.audit || e.edit || ins.edit,
    made := list_concat(list_concat(v.best.made, CASE WHEN e.edit = 'D' THEN []::VARCHAR[] ELSE [coalesce(e.gives, f.role) || ':' || f.text] END), ins.added)))
  FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1 JOIN e ON e.before = v.state AND (e.needs IS NULL OR e.needs = f.initial) AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) JOIN ins ON ins.before = e.after
  GROUP BY 1, 2, 3),
n AS (SELECT conv_id, max(i) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY 1),
g AS (SELECT conv_id, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f) GROUP BY 1),
b AS (SELECT v.conv_id, min(best) AS best FROM v JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id AND v.i = n.n WHERE state IN {_ENDS} GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
sha256(coalesce(array_to_string(best.made, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""
