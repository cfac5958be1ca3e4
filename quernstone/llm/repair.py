"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, found in one pass over its rows.

A row is kept, given another role or deleted, and empty turns are inserted before rows or at the end, until the roles' initials
read `(s?(ua)+)?`. Four states of that pattern are enough, so the best audit (the edits' initials) of each state is carried from
row to row. Audits share their beginnings: an edit is a node that points to the one before it, to its ancestors 1, 2, 4, ... steps
back, and holds a rolling hash of the whole audit. Of two audits that cost the same, the first differing edit is found by searching
the ancestors for the longest common prefix; where the hashes say that two prefixes are equal, the nodes are compared before it is
believed. What all four audits share is decided, and becomes one byte an edit.

Rows reach a task sorted by conversation and turn, and a task holds no texts: each state carries the SHA-256 state of what it has
repaired so far. A conversation is read by one task, since SHA-256 takes a text in order; it takes a byte of memory for a decided
edit, which is the audit it returns, and nodes for those since the audits of the states parted. Repeated texts are found before, by an aggregate over their hashes, so a long conversation needs
no set of what was seen.

Results in special cases:
- null roles and texts are one space (so such a text is blank); null turns come first; a null conv_id is a conversation;
- rows of one turn are ordered by role, then text, each by code points; equal ones are copies, of which the first is no duplicate;
- a conversation without rows has zeros, an empty audit and the hash of nothing; an empty table gives no rows;
- roles other than system, user and assistant fit nowhere and must be given another role or deleted, unless they share an initial;
- gaps beyond a long are the largest long; columns beside conv_id, turn, role, text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
BASE, PRIME = 1_000_003, (1 << 61) - 1
FEW = 1_000_000  # repeated texts that are sent to all tasks; more are joined by a shuffle
NODES = 1 << 15  # nodes that are kept before what is decided is written off
# what it costs at most to go on from one state as if from another: turns inserted, or a system turn deleted
DETOUR = {(0, 1): 0, (0, 2): 3, (0, 3): 6, (1, 0): 6, (1, 2): 3, (1, 3): 6, (2, 0): 7, (2, 1): 3, (2, 3): 3, (3, 0): 4, (3, 1): 0, (3, 2): 3}
# states: nothing yet, a system turn, a user turn, an assistant turn
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
SPACE = r"\x20\x09-\x0D"


class Audits:
    """Edits as linked nodes; node 0 is the empty audit of what is not yet decided."""

    def __init__(self) -> None:
        self.decided = bytearray()
        self._reset()

    def _reset(self) -> None:
        self.edit, self.up, self.depth, self.hash = [""], [[]], [0], [0]

    def add(self, node: int, edit: str) -> int:
        new, up, level = len(self.edit), [node], 0
        while level < len(self.up[up[-1]]):
            up.append(self.up[up[-1]][level])
            level += 1
        self.edit.append(edit)
        self.up.append(up)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(edit)) % PRIME)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        steps, level = self.depth[node] - depth, 0
        while steps:
            if steps & 1:
                node = self.up[node][level]
            steps >>= 1
            level += 1
        return node

    def _edits(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether two prefixes of equal hash are equal; shared ones are one node, so this ends at once."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit a comes before audit b."""
        if a == b:
            return False
        common = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, common), self.ancestor(b, common)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self._edits(a) < self._edits(b)
        for level in range(len(self.up[x]) - 1, -1, -1):
            if level < len(self.up[x]) and self.hash[self.up[x][level]] != self.hash[self.up[y][level]]:
                x, y = self.up[x][level], self.up[y][level]
        if not self._same(self.up[x][0], self.up[y][0]):
            return self._edits(a) < self._edits(b)
        return self.edit[x] < self.edit[y]

    def settle(self, nodes: list[int]) -> list[int]:
        """Write off what all nodes share; their numbers afterwards."""
        depth = min(self.depth[n] for n in nodes)
        meet = [self.ancestor(n, depth) for n in nodes]
        while len(set(meet)) > 1:
            meet = [self.up[n][0] for n in meet]
            depth -= 1
        self.decided += self._edits(meet[0]).encode()
        tails = []
        for n in nodes:
            tail = []
            while n != meet[0]:
                tail.append((n, self.edit[n]))
                n = self.up[n][0]
            tails.append(tail[::-1])
        self._reset()
        new, out = {}, []
        for tail in tails:
            at = 0
            for old, edit in tail:
                if old not in new:
                    new[old] = self.add(at, edit)
                at = new[old]
            out.append(at)
        return out

    def text(self, node: int) -> str:
        return self.decided.decode() + self._edits(node)


class Repair:
    """One conversation: its rows in order, then `result`."""

    def __init__(self) -> None:
        self.audits = Audits()
        # state -> (cost, node, SHA-256 of what is repaired so far, whether there is something)
        self.best = {0: (0, 0, hashlib.sha256(), False)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = self.last = None
        self.most = NODES

    def _better(self, cost: int, node: int, edit: str, than: tuple | None) -> int | None:
        """The new node if this cost and audit beat what a state has."""
        if than is not None and than[0] < cost:
            return None
        new = self.audits.add(node, edit)
        if than is None or cost < than[0] or self.audits.less(new, than[1]):
            return new
        return None

    @staticmethod
    def _told(entry: tuple, line: str) -> tuple:
        done = entry[2].copy()
        done.update((("\n" if entry[3] else "") + line).encode("utf-8", "surrogatepass"))
        return done, True

    def _inserted(self) -> dict:
        """The best of each state once turns may have been inserted."""
        best = dict(self.best)
        for to, role, sources in ((2, "user", (0, 1, 3)), (3, "assistant", (2,))):
            for source in sources:
                if (entry := best.get(source) if to == 3 else self.best.get(source)) is not None:
                    cost = entry[0] + COST[INSERT]
                    new = self._better(cost, entry[1], INSERT, best.get(to))
                    if new is not None:
                        best[to] = (cost, new, *self._told(entry, f"{role}:"))
        return best

    def row(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += self.last_turn != turn
            self.last_turn = turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        more = TRUNCATED if fault == "truncated" else 0
        gone = fault in ("blank", "duplicate")
        new: dict[int, tuple] = {}
        for state, entry in self._inserted().items():
            options = [(state, DELETE, "")]
            if not gone:
                kept = STEPS.get(initial, {}).get(state)
                if kept is not None:
                    options.append((kept, KEEP, role))
                options.append((3, REROLE, "assistant") if state == 2 else (2, REROLE, "user"))
            for to, edit, speaker in options:
                cost = entry[0] + COST[edit] + (0 if edit == DELETE else more)
                node = self._better(cost, entry[1], edit, new.get(to))
                if node is not None:
                    new[to] = (cost, node, entry[2], entry[3]) if edit == DELETE else (cost, node, *self._told(entry, f"{speaker}:{text}"))
        # a state that another one can stand in for at a lower cost is never part of the cheapest audit
        new = {s: e for s, e in new.items() if all(e[0] <= o[0] + DETOUR[t, s] for t, o in new.items() if t != s)}
        if len(self.audits.edit) > self.most:
            nodes = self.audits.settle([entry[1] for entry in new.values()])
            new = {s: (entry[0], node, *entry[2:]) for (s, entry), node in zip(new.items(), nodes)}
            self.most = max(NODES, 2 * len(self.audits.edit))
        self.best = new

    def result(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        ends = [entry for state, entry in self._inserted().items() if state in (0, 3)]
        won = ends[0]
        for entry in ends[1:]:
            if entry[0] < won[0] or entry[0] == won[0] and self.audits.less(entry[1], won[1]):
                won = entry
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, won[0], self.audits.text(won[1]), won[2].hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with the faults that their number draws. A dropped row stays as a mark with `gone`."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    fault = F.crc32(name) % 20
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault <= 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (fault == 0).alias("gone"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _content() -> Column:
    """A hash that tells rows of one conversation apart by role and text."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))


def faults(rows: DataFrame) -> DataFrame:
    """The same rows with blank, truncated and `again`: whether an earlier turn has the same role and text."""
    marked = rows.withColumns({
        "blank": ~F.col("text").rlike(f"[^{SPACE}]"),
        "truncated": F.col("text").rlike(f"[^.!?{SPACE}][{SPACE}]*\\z"),
        "content": _content(),
    })
    turn = F.struct("turn")  # nulls first
    seen = marked.where(~F.col("gone") & ~F.col("blank")).groupBy("conv_id", "content").agg(F.min(turn).alias("first_"), F.max(turn).alias("last_"))
    repeated = cut(seen.where("first_ < last_").select(F.xxhash64("conv_id").alias("conv_"), F.col("conv_id").alias("of_"), "content", "first_"), "repeated")
    marked = marked.withColumn("conv_", F.xxhash64("conv_id"))
    if repeated.count() <= FEW:
        found = marked.join(F.broadcast(repeated), (marked["conv_"] == repeated["conv_"]) & (marked["content"] == repeated["content"]) & marked["conv_id"].eqNullSafe(repeated["of_"]), "left")
        found = found.drop(repeated["conv_"]).drop(repeated["content"])
    else:
        # one row for each key: a hash of two conversations that were equal would be a second one
        one = repeated.groupBy("conv_", "content").agg(F.collect_list(F.struct("of_", "first_")).alias("firsts_"))
        found = join_spread(cut(marked, "marked"), one, ["conv_", "content"], ["turn"], "left")
        found = found.withColumn("first_", F.filter("firsts_", lambda p: p["of_"].eqNullSafe(F.col("conv_id")))[0]["first_"])
    return found.select("conv_id", "turn", "role", "text", "gone", "blank", "truncated", F.coalesce(F.col("first_") < turn, F.lit(False)).alias("again"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation (rows as `damaged` gives them)."""
    kind = dict(rows.dtypes)["conv_id"]
    dealt = faults(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, now, before = None, None, None
        held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            kinds = [ids, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=NAMES)

        for batch in batches:
            ids = batch.column(0).type
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                for c, turn, role, text, gone, blank, truncated, again in zip(*[part.column(i).to_pylist() for i in range(8)]):
                    if now is None or c != conv:
                        if now is not None:
                            done.append((conv, *now.result()))
                            held += len(done[-1][7])
                        conv, now, before = c, Repair(), None
                        if len(done) >= 1000 or held > 1_000_000:
                            yield out()
                            done, held = [], 0
                    if gone:
                        continue
                    this = (turn, role, text)
                    now.row(turn, role, text, blank, again or this == before, truncated)
                    before = this
        if now is not None:
            done.append((conv, *now.result()))
        if done:
            yield out()

    return dealt.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
