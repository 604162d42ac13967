"""Repair of conversations whose rows are damaged: least edits by a DP shared in a trie.

A row's *sign* is one letter for its role's initial and its first fault, and the
signs of a conversation in order are its signature. What a repair costs depends
on the signature alone. So:

1. small rows (no texts, but their SHA-256) are grouped by conversation, faults
   are marked in window expressions, and a signature is joined from the stream;
2. signatures are sorted over all tasks. Each task inserts its own into a prefix
   trie, of which it keeps the path of the last one: equal beginnings are
   neighbours, so a node's DP layer is computed once and popped when it is done.
   Terminal nodes give costs and audits. Conversations with one signature may be
   many: the sort goes on by ``conv_id``, so they are dealt over several tasks;
3. the answers go before the texts of their conversations, in one sort, and the
   repaired text is hashed as it streams by. No conversation is ever held whole:
   of one, a task holds its signature and its audit, a letter a row.

A DP layer has, for each state of ``(s?(ua)+)?``, the least cost, the rank of the
audit among the layer's audits, and the way back. Audits of a layer all end with
the letter of the same row, so none begins another and ranks decide all ties.

Defined results: null roles and texts are one space, and a null ``conv_id`` or
``turn`` is one space in the damage's key; null turns come first; a null
``conv_id`` is a conversation of its own. Rows that tie in turn stand in the order
of role, then of the text's SHA-256; rows that repeat each other are duplicates.
An empty role can't be kept as it is (like any that starts with neither s, u nor
a). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
#: Signs: the letter of the role (o: another) for sound rows, and where they are blank, repeated or cut.
SOUND, BLANK, REPEATED, CUT = "suao", "SUAO", "1234", "5678"
#: Costs of an edit and of a row that stays cut.
REROLE, DELETE, INSERT, STAYS_CUT = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. What an inserted or reroled row makes of each.
NEXT = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
START = ((0, 0, None, ""), None, None, None)


def steps(sign: str) -> list[tuple[int, int, str, int]]:
    """(from, to, letters, cost) of all ways past a row: inserts, then its own edit."""
    fault = next(i for i, kind in enumerate((SOUND, BLANK, REPEATED, CUT)) if sign in kind)
    role = "suao"[(SOUND, BLANK, REPEATED, CUT)[fault].index(sign)]
    stays = STAYS_CUT * (fault == 3)
    out = []
    for start in range(4):
        at, before, cost = start, "", 0
        for _ in range(3):
            out.append((start, at, before + "D", cost + DELETE))
            if fault in (0, 3):
                out.append((start, NEXT[at], before + "R", cost + REROLE + stays))
                if at in KEPT[role]:
                    out.append((start, KEPT[role][at], before + "K", cost + stays))
            at, before, cost = NEXT[at], before + "I", cost + INSERT
    return out


STEPS = {sign: steps(sign) for sign in SOUND + BLANK + REPEATED + CUT}
#: Inserts that end a conversation well, by state.
LAST = ((0, "", 0), (1, "II", 2 * INSERT), (2, "I", INSERT), (3, "", 0))


def layer(before: tuple, sign: str) -> tuple:
    """The next DP layer: (cost, rank, from, letters) a state, or None."""
    best: list = [None] * 4
    for start, end, letters, cost in STEPS[sign]:
        if (held := before[start]) is not None:
            found = (held[0] + cost, held[1], letters, start)
            if best[end] is None or found < best[end]:
                best[end] = found
    ranks = {key: i for i, key in enumerate(sorted(b[1:3] for b in best if b))}
    return tuple(b and (b[0], ranks[b[1:3]], b[3], b[2]) for b in best)


def answer(path: list[tuple]) -> tuple[int, str]:
    """Cost and audit at a terminal node, whose path of layers starts with START."""
    ends = [(path[-1][s][0] + cost, path[-1][s][1], letters, s) for s, letters, cost in LAST if path[-1][s] is not None]
    cost, _, letters, state = min(ends)
    parts = [letters]
    for held in path[:0:-1]:
        _, _, state, letters = held[state]
        parts.append(letters)
    return cost, "".join(reversed(parts))


class Trie:
    """The rightmost path of a trie into which signatures come in order."""

    def __init__(self) -> None:
        self.signature, self.path, self.held, self.nodes = "", [START], None, 0

    def insert(self, signature: str) -> tuple[int, str]:
        if self.held is None or signature != self.signature:
            old, shared = self.signature, 0
            least = min(len(old), len(signature))
            if old[:least] == signature[:least]:
                shared = least
            else:
                while old[shared] == signature[shared]:
                    shared += 1
            del self.path[shared + 1 :]
            for sign in signature[shared:]:
                self.path.append(layer(self.path[-1], sign))
                self.nodes += 1
            self.signature, self.held = signature, answer(self.path)
        return self.held


def initials(signature: str) -> str:
    """The roles of a signature, whatever their faults."""
    return signature.translate(str.maketrans(BLANK + REPEATED + CUT, SOUND * 3))


def broken_turns(signature: str) -> int:
    """Neighbours whose roles are none of su, ua and au."""
    roles = initials(signature)
    legal = sum(roles.count(pair) for pair in ("su", "ua", "au"))  # no pair overlaps itself
    return max(len(roles) - 1, 0) - legal


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies per row; 0 copies: the row is dropped, 2: it is repeated."""
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(filled("text"), STOPS, "")).otherwise(filled("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, nth, signs per row of ``damaged``; a row has as many signs as copies."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.select(
        "conv_id", "turn", "role", "copies",
        F.when(body == "", "blank").when(F.instr(F.lit(STOPS), F.substring(body, -1, 1)) == 0, "cut").otherwise("sound").alias("fault"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    ).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("copies") == 0, F.col("turn").asc_nulls_first())
    light = light.withColumn("nth", F.row_number().over(seen))
    role = F.substring("role", 1, 1)
    role = F.when(role.isin("s", "u", "a"), role).otherwise("o")

    def sign(kind: str) -> Column:
        return F.translate(role, SOUND, kind)

    first = (
        F.when(F.col("fault") == "blank", sign(BLANK))
        .when(F.col("nth") > 1, sign(REPEATED))
        .when(F.col("fault") == "cut", sign(CUT))
        .otherwise(role)
    )
    again = F.when(F.col("fault") == "blank", sign(BLANK)).otherwise(sign(REPEATED))
    signs = F.when(F.col("copies") == 0, "").when(F.col("copies") == 2, F.concat(first, again)).otherwise(first)
    return light.select("conv_id", "turn", "role", "digest", "nth", signs.alias("signs"))


def join_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, gaps, signature from rows in the order of conversation, turn, role and digest."""
    kind = None
    now, parts, turns, low, high = None, None, 0, None, None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for conv, turn, signs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "signs")), strict=True):
            if parts is None or conv != now:
                if parts is not None:
                    out.append((now, high - low + 1 - turns if turns else 0, "".join(parts)))
                now, parts, turns, low, high = conv, [], 0, None, None
            if signs:
                parts.append(signs)
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
        yield listed(out, kind)
    if parts is not None:
        yield listed([(now, high - low + 1 - turns if turns else 0, "".join(parts))], kind)


def listed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    convs, gaps, signatures = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(gaps, pa.int64()), pa.array(signatures, pa.string())], names=["conv_id", "gaps", "signature"])


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of COUNTS and the audit of signatures that come in order."""
    trie = Trie()
    for batch in batches:
        out = []
        last, row = None, None
        for signature in batch.column("signature").to_pylist():
            if signature != last:
                faults = [sum(signature.count(c) for c in kind) for kind in (BLANK, REPEATED, CUT)]
                cost, audit = trie.insert(signature)
                last, row = signature, (*faults, broken_turns(signature), cost, audit)
            out.append(row)
        columns = zip(*out, strict=True) if out else [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("gaps"), *arrays], names=["conv_id", "gaps", *COUNTS, "audit"])


class Repair:
    """The repaired rows of one conversation, as its audit and its rows come in."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.first = audit, 0, 0, True
        self.hash = hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        line = f"{role}:{text}" if self.first else f"\n{role}:{text}"
        self.hash.update(line.encode())
        self.first = False

    def made(self, text: str) -> None:
        self.state = NEXT[self.state]
        self.put("user" if self.state == 2 else "assistant", text)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.made("")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.made(text)
        elif edit == "K":
            self.state = KEPT[role[0]][self.state]
            self.put(role, text)

    def end(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def hash_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's answer, which comes before its texts, with the hash of what its audit makes of them."""
    names = ["conv_id", "gaps", *COUNTS, "audit"]
    now, held = None, None
    schema = None
    for batch in batches:
        schema = pa.schema([batch.schema.field(n) for n in names])
        out = []
        rows = {n: batch.column(n).to_pylist() for n in ("audit", "role", "text", "copies")}
        for i, (audit, role, text, copies) in enumerate(zip(*rows.values(), strict=True)):
            if audit is not None:
                if held is not None:
                    out.append((*now, held.end()))
                now, held = tuple(batch.column(n)[i].as_py() for n in names), Repair(audit)
            else:
                for _ in range(copies):
                    held.row(role, text)
        yield answers(out, schema)
    if held is not None:
        yield answers([(*now, held.end())], schema)


def answers(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    schema = schema.append(pa.field("repaired_sha256", pa.string()))
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, the columns of COUNTS and audit per conversation of ``damaged`` rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = signed(rows).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "nth")
    signatures = cut(ordered.select("conv_id", "turn", "signs").mapInArrow(join_signs, f"conv_id {kind}, gaps long, signature string"))
    # by conv_id as well: a signature that very many share goes to more than one task
    in_order = signatures.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return cut(in_order.mapInArrow(solve, f"conv_id {kind}, gaps long, {counts}, audit string"))


def streamed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Each conversation's row of ``heads``, then its rows in order, in one task."""
    texts = rows.where("copies > 0").withColumn("digest", F.unhex(F.sha2("text", 256)))
    both = heads.withColumn("head", F.lit(True)).unionByName(texts.withColumn("head", F.lit(False)), allowMissingColumns=True)
    order = ["conv_id", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*order).drop("head", "turn", "digest")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conv_id."""
    rows = damaged(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"conv_id {kind}, gaps long, {counts}, audit string, repaired_sha256 string"
    return streamed(rows, audits(rows)).mapInArrow(hash_repaired, schema)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit (K, R or I) of the repaired conversations, as written."""
    rows = damaged(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    heads = audits(rows).select("conv_id", "audit")
    return streamed(rows, heads).mapInArrow(write_repaired, f"conv_id {kind}, place long, role string, text string, edit string")


class Kept(Repair):
    """Repair that lists the rows instead of hashing them."""

    def __init__(self, audit: str, conv, out: list) -> None:
        super().__init__(audit)
        self.conv, self.out, self.place = conv, out, 0

    def put(self, role: str, text: str) -> None:
        edit = self.audit[self.at - 1]
        self.out.append((self.conv, self.place, role, text, edit))
        self.place += 1


def write_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out, kind = None, [], None

    def batch_of() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "role", "text", "edit"])
        out.clear()
        return made

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        names = ("conv_id", "audit", "role", "text", "copies")
        for conv, audit, role, text, copies in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if audit is not None:
                if held is not None:
                    held.inserts()
                held = Kept(audit, conv, out)
            else:
                for _ in range(copies):
                    held.row(role, text)
        yield batch_of()
    if held is not None:
        held.inserts()
        yield batch_of()
