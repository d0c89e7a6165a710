"""Conversation structure repair: the cheapest edits that make a legal sequence of roles.

Each conversation is read by turn. A row may be kept, given another role or deleted, and
rows of empty text may be inserted anywhere, so that the initials of the roles read
``(s?(ua)+)?``. Which rows to edit is the shortest path through a DAG whose nodes are
(row, state of that pattern). The weight of a path is one integer: its high digits are
the cost, its low digits, three bits each, are the letters of its edits from the first
on, padded with zeros to a fixed width. The smaller integer is thus the cheaper path, and
of equally cheap ones that of the ASCII-least audit; nothing but the minimum of integers
decides. (Two paths into one node never have audits of which one begins the other: the
letters behind the shorter would be insertions that lead back to the same state.)

A conversation's rows are sorted by Spark, spilling where they must, and pass through its
task as a stream, each once: of the past only four integers, four running hashes and the
letters are held. When the integers are full, the letters that all paths have reached move
into a list, and a single leading digit keeps the order of what the four paths left there:
the integers stay short however long a conversation is. The hash of a whole repaired conversation has
to see its rows one after the other, so a conversation is not split over tasks; repeated
rows are found within the same partitioning, without a further shuffle.

Order within a conversation: turn (nulls first), then role, then text.

Rows: null role and text count as one blank, a null conv_id is a conversation of its own
and, like a null turn, one blank in the key of the damage. Roles with another initial, or
none, can't be kept. Repeated rows are duplicates. An empty table gives an empty result.
Other columns are ignored, whatever their names. ``gaps`` never exceeds the largest long.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landcompare.llm.common import table

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REPORT = (
    "conv_id BIGINT, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT, audit STRING, repaired_sha256 STRING"
)
EDITED = "conv_id BIGINT, place BIGINT, edit STRING, role STRING, text STRING"

# The legal moves: none yet, behind s, behind u, behind a.
NONE, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL_PAIRS = {"su", "ua", "au"}
NEXT = {NONE: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LETTERS = "\0DIKR"  # an edit's digit is its place here: in ASCII order, zero is padding
D, I, K, R = range(1, 5)
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
BITS, WIDTH = 3, 96


# Rows and their faults


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the columns in use, null role and text as one blank."""
    blank = F.lit(" ")
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"), F.lit(1).alias("copies"))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with reproducible faults: one in twenty each is dropped (copies 0), emptied, cut, repeated (copies 2) or made the user's."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows_of(conversations).withColumn("fault", F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def in_order(rows: DataFrame) -> DataFrame:
    """Each copy as a row with its faults, conversations whole in a partition and sorted. Rows of no copy stay as their conversation's mark."""
    copy = F.explode(F.sequence(F.least(F.col("copies"), F.lit(1)), F.col("copies"))).alias("copy")
    there = F.col("copy") > 0
    rows = rows.select("conv_id", "turn", "role", "text", copy)
    rows = rows.select("conv_id", "turn", *[F.when(there, F.col(c)).alias(c) for c in ("role", "text")], there.alias("there"))
    rows = rows.repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(earlier) > 1)
    rows = rows.withColumn("last", F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1)))
    first = F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("last").isin(*ENDS), "truncated")
    rows = rows.select("conv_id", "turn", "role", "text", "there", first.alias("fault"))
    return rows.sortWithinPartitions("conv_id", *order(), F.col("fault").eqNullSafe("duplicate"))


# The DAG


class Paths:
    """The least path into each state so far: its weight, its number of letters, and the hash of what it keeps."""

    def __init__(self) -> None:
        self.width = WIDTH
        # The first digit is the order of the letters left behind, none at first.
        self.weights, self.lengths = [1 << BITS * (WIDTH - 1), None, None, None], [1, 0, 0, 0]
        self.behind: list[tuple | None] = [None] * 4  # (what was left before, letters)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.spent = 0  # cost common to all paths, taken out of the weights

    def _weight(self, state: int, cost: int, letter: int) -> int:
        return self.weights[state] + (cost << BITS * self.width) + (letter << BITS * (self.width - 1 - self.lengths[state]))

    def _kept(self, state: int, line: bytes):
        found = self.hashes[state].copy()
        found.update(line if state == NONE else b"\n" + line)
        return found

    def insert(self) -> None:
        for state, after in ((NONE, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            if self.weights[state] is not None:
                weight = self._weight(state, INSERT, I)
                if self.weights[after] is None or weight < self.weights[after]:
                    self.hashes[after] = self._kept(state, NEXT[state][0].encode() + b":")
                    self.weights[after], self.lengths[after] = weight, self.lengths[state] + 1
                    self.behind[after] = self.behind[state]

    def row(self, role: str, text: str, fault: str | None) -> None:
        self.insert()
        best: list[tuple | None] = [None] * 4
        cut = CUT if fault == "truncated" else 0
        for state, weight in enumerate(self.weights):
            if weight is None:
                continue
            found = [(self._weight(state, DELETE, D), state, state, None)]
            if fault is None or cut:
                after = MOVES.get((role[:1], state))
                if after is not None:
                    found.append((self._weight(state, cut, K), after, state, role))
                other, after = NEXT[state]
                found.append((self._weight(state, REROLE + cut, R), after, state, other))
            for edge in found:
                if best[edge[1]] is None or edge[0] < best[edge[1]][0]:
                    best[edge[1]] = edge
        data = b":" + text.encode()
        hashes, lengths = self.hashes, self.lengths
        self.hashes = [None if e is None else hashes[e[2]] if e[3] is None else self._kept(e[2], e[3].encode() + data) for e in best]
        self.lengths = [0 if e is None else lengths[e[2]] + 1 for e in best]
        self.behind = [None if e is None else self.behind[e[2]] for e in best]
        self.weights = [None if e is None else e[0] for e in best]
        if max(self.lengths) + 4 > self.width:
            self.settle()

    def settle(self) -> None:
        """Leaves behind as many letters as the shortest path has, and widens the integers if the others have many more."""
        low = BITS * self.width
        # What may follow "none yet" or s may follow a too, for 3 more at most (an s deleted instead of kept): dearer paths can't win.
        for state, more in ((NONE, DELETE), (SYSTEM, 0)):
            weights = self.weights[state], self.weights[ASSISTANT]
            if None not in weights and weights[0] >> low > (weights[1] >> low) + more:
                self.weights[state], self.lengths[state], self.behind[state], self.hashes[state] = None, 0, None, None
        alive = [s for s in range(4) if self.weights[s] is not None]
        least = min(self.weights[s] >> low for s in alive)
        reached = min(self.lengths[s] for s in alive)
        digits = {s: self.weights[s] & (1 << low) - 1 for s in alive}
        left = {s: digits[s] >> low - BITS * reached for s in alive}
        order = {x: k for k, x in enumerate(sorted(set(left.values())), 1)}
        wider = max(0, max(self.lengths) - reached + WIDTH // 2 - self.width)
        for s in alive:
            self.behind[s] = self.behind[s], letters(left[s], reached, reached)[1:]
            rest = (digits[s] & (1 << low - BITS * reached) - 1) << BITS * (reached - 1)
            cost = (self.weights[s] >> low) - least
            self.weights[s] = ((cost << low) + (order[left[s]] << low - BITS) + rest) << BITS * wider
            self.lengths[s] -= reached - 1
        self.spent += least
        self.width += wider

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the least path that ends legally."""
        self.insert()
        state = min((s for s in (NONE, ASSISTANT) if self.weights[s] is not None), key=lambda s: self.weights[s])
        low = BITS * self.width
        audit = [letters(self.weights[state] & (1 << low) - 1, self.width, self.lengths[state])[1:]]
        behind = self.behind[state]
        while behind is not None:
            behind, part = behind
            audit.append(part)
        return self.spent + (self.weights[state] >> low), "".join(reversed(audit)), self.hashes[state].hexdigest()


def letters(digits: int, width: int, n: int) -> str:
    """The first n letters: a digit of three bits is an octal one."""
    return f"{digits:0{width}o}"[:n].translate({ord(str(k)): c for k, c in enumerate(LETTERS)}) if n else ""


class Conversation:
    """Counts and paths of one conversation, fed row by row."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.first, self.turn, self.initial = 0, 0, None, None, None
        self.paths = Paths()

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = role[:1]
        if fault:
            self.faults[fault] += 1
        self.paths.row(role, text, fault)

    def report(self) -> tuple:
        gaps = min(self.turn - self.first + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, *self.paths.end()


# Operator


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (``rows_of`` or ``damage``): its faults, the cheapest cost, the audit and the hash of the repaired text."""
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("STRING") else pa.int64()) for f in REPORT.split(", ")])

    def run(batches):
        of, now = None, None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, there, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv_id != of:
                    if now is not None:
                        done.append((of, *now.report()))
                    of, now = conv_id, Conversation()
                if there:
                    now.add(turn, role, text, fault)
            if done:
                yield _batch(done, schema)
        if now is not None:
            yield _batch([(of, *now.report())], schema)

    return in_order(rows).mapInArrow(run, REPORT)


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the edits of each conversation's audit in order, deleted rows with null role and text."""
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("STRING") else pa.int64()) for f in EDITED.split(", ")])

    def run(batches):
        of, edits = None, Edits("")
        for batch in batches:
            done = []
            for conv_id, audit, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")], strict=True):
                if audit is not None:  # a conversation's first row
                    done += ((of, *e) for e in edits.insertions())
                    of, edits = conv_id, Edits(audit)
                else:
                    done += ((of, *e) for e in edits.row(role, text))
            if done:
                yield _batch(done, schema)
        last = [(of, *e) for e in edits.insertions()]
        if last:
            yield _batch(last, schema)

    heads = report.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("text", "string"))])
    sorted_rows = in_order(rows).where("there").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    both = heads.unionByName(sorted_rows).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("audit").isNull(), *order()).mapInArrow(run, EDITED)


class Edits:
    """The edits of an audit, (place, edit, role, text), as the rows of its conversation come in."""

    def __init__(self, audit: str) -> None:
        self.audit, self.place, self.state = audit, 0, NONE

    def _edit(self, role: str | None, text: str | None) -> tuple:
        edit = self.audit[self.place]
        if edit == "K":
            self.state = MOVES[role[:1], self.state]
        elif edit == "D":
            role = text = None
        else:
            role, self.state = NEXT[self.state]
        self.place += 1
        return self.place - 1, edit, role, text

    def insertions(self) -> list[tuple]:
        found = []
        while self.audit[self.place : self.place + 1] == "I":
            found.append(self._edit(None, ""))
        return found

    def row(self, role: str, text: str) -> list[tuple]:
        return [*self.insertions(), self._edit(role, text)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


# The same in SQL: from the last row back, each state's least (cost, audit) and the lines it keeps.
_START = "struct_pack(cost := 0::BIGINT, audit := '', lines := []::VARCHAR[])"


def _edge(cost: str, letter: str, line: str | None, after: str) -> str:
    lines = f"list_prepend({line}, {after}.lines)" if line else f"{after}.lines"
    return f"struct_pack(cost := {after}.cost + {cost}, audit := '{letter}' || {after}.audit, lines := {lines})"


def _inserted(role: str, after: str) -> str:
    return _edge("2", "I", f"'{role}:'", after)


def _acts(state: str, other: str, after: str, kept: str) -> str:
    """The least of deleting the row, giving it the other role, and keeping it where ``kept`` has a case for it."""
    drop, change = _edge("3", "D", None, state), _edge("2 + cut", "R", f"'{other}:' || text", after)
    return f"list_min([{drop}, CASE WHEN may THEN {change} END, CASE WHEN may THEN CASE left(role, 1) {kept} END END])"


def _keep(initial: str, after: str) -> str:
    return f"WHEN '{initial}' THEN {_edge('cut', 'K', "role || ':' || text", after)}"


_FINAL_A = _START
_FINAL_U = _inserted("assistant", _FINAL_A)
_FINAL_S = _inserted("user", f"({_FINAL_U})")
_STEP = "CASE WHEN k % 8 = 0 THEN xor(a, ascii(key[k // 8 + 1])::BIGINT) ELSE a END"

SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(key))),
    lambda a, k: xor(({_STEP}) >> 1, 3988292384 * (({_STEP}) & 1)))) % 20 AS fault
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE fault <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS i,
    lag(left(role, 1)) OVER w || left(role, 1) AS pair
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' END AS fault
  FROM placed
), steps AS (
  SELECT conv_id, i, role, text, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS may, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), paths AS (
  SELECT conv_id, n AS i, {_START} AS none, {_FINAL_S} AS s, {_FINAL_U} AS u, {_FINAL_A} AS a FROM counts
  UNION ALL
  SELECT conv_id, i, list_min([none, {_inserted("user", "u")}]), list_min([s, {_inserted("user", "u")}]),
    list_min([u, {_inserted("assistant", "a")}]), list_min([a, {_inserted("user", "u")}])
  FROM (
    SELECT conv_id, i - 1 AS i, {_acts("none", "user", "u", _keep("s", "s") + " " + _keep("u", "u"))} AS none,
      {_acts("s", "user", "u", _keep("u", "u"))} AS s, {_acts("u", "assistant", "a", _keep("a", "a"))} AS u,
      {_acts("a", "user", "u", _keep("u", "u"))} AS a
    FROM (SELECT p.*, r.role, r.text, r.may, r.cut FROM paths p JOIN steps r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i)
  )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(none.cost, 0) AS cost, coalesce(none.audit, '') AS audit,
  sha256(coalesce(array_to_string(none.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN paths p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.i = 0
"""
