"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tickloom.llm import conversations
from tickloom.llm.common import table

WHITE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    """(conv, turn, role, text) after damage, and all ids."""
    out = []
    for conv, turn, role, text in rows:
        one = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{one[0]}:{one[1]}".encode()) % 20
        role, text = one[2:]
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, found):
    """Least (cost, audit, repaired) by keeping every way of each state, cheapest and ASCII-least first."""
    nxt = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    name = {"u": "user", "a": "assistant"}

    def spread(ways):
        done = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(done.items()):
                letter, to = nxt[state]
                way = (cost + 3, audit + "I", (*lines, (name[letter], "")))
                if to not in done or way[:2] < done[to][:2]:
                    done[to] = way
        return done

    # ways from the end of the row on can't begin one another unless one is cheaper, so the best of a state is enough
    ways = {0: (0, "", ())}
    for (role, text), fault in zip(rows, found, strict=True):
        ways, new = spread(ways), {}
        for state, (cost, audit, lines) in ways.items():
            options = [(cost + 4, audit + "D", lines, state)]
            if fault in ("", "truncated"):
                stays = 3 * (fault == "truncated")
                letter, to = nxt[state]
                options.append((cost + 3 + stays, audit + "R", (*lines, (name[letter], text)), to))
                keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
                if keep is not None:
                    options.append((cost + stays, audit + "K", (*lines, (role, text)), keep))
            for cost_, audit_, lines_, to in options:
                if to not in new or (cost_, audit_) < new[to][:2]:
                    new[to] = (cost_, audit_, lines_)
        ways = new
    ways = spread(ways)
    cost, audit, lines = min(ways[s] for s in (0, 3) if s in ways)
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def every_edit(rows, found):
    """The same by trying all edits of a few rows with up to two inserts anywhere."""
    best = None
    gaps = ["", "I", "II"]
    for edits in itertools.product("DKR", repeat=len(rows)):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            audit = "".join(i + e for i, e in itertools.zip_longest(inserted, edits, fillvalue=""))
            cost, state, ok, at = 0, "", True, 0
            for e in audit:
                if e == "I":
                    cost += 3
                    state += "a" if state.endswith("u") else "u"
                    continue
                (role, _), fault = rows[at], found[at]
                at += 1
                if e == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    ok = False
                    break
                cost += 3 * (fault == "truncated") + 3 * (e == "R")
                state += role[:1] if e == "K" else "a" if state.endswith("u") else "u"
            if ok and re.fullmatch("(s?(ua)+)?", state) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def brute(rows):
    by, ids = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in damage(rows):
        by[conv].append((turn, role, text))
    out = []
    for conv in ids:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        own = [r[1:] for r in own]
        found = faults(own)
        cost, audit, text = search(own, found)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def same(got, want):
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repair_of_real_rows(spark, sf):
    data = table(spark, f"/root/testdata/{sf}", "conversations")
    same(conversations.repair(data), brute(rows_of(data)))


def test_repair_of_odd_rows(spark):
    rng = random.Random(5)
    texts = ["a.", "b", " \n", "", None, "c!", "d? ", "long " * 20_000, "e. ", "f?\x0b"]
    roles = ["user", "assistant", "system", "tool", None, "", "useful", "System"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(150) for _ in range(rng.randint(1, 12))]
    rows += [(None, t, "user", "null conversation.") for t in (0, 0, 1)] + [(-5, 10**12, "user", "x."), (-5, -3, "user", "x.")]
    rows += [rows[0]] * 3
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, copies int, digest string, head int").repartition(5)
    same(conversations.repair(df), brute(rows))


def test_repair_of_a_conversation_with_very_many_rows(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["yes.", f"turn {t}.", f"cut {t}"])) for t in range(20_000)]
    same(conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)), brute(rows))


def test_nothing_to_repair(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(empty).collect() == [] and conversations.repaired_rows(empty).collect() == []


def test_least_edits_against_all_edits():
    rng = random.Random(7)
    signs = [("user", "x."), ("assistant", "y."), ("system", "z."), ("tool", "t."), ("user", ""), ("user", "cut"), ("assistant", "cut")]
    for _ in range(150):
        rows = [rng.choice(signs) for _ in range(rng.randint(0, 4))]
        found = faults(rows)
        kinds = {"": conversations.SOUND, "blank": conversations.BLANK, "duplicate": conversations.REPEATED, "truncated": conversations.CUT}
        signature = "".join(kinds[f]["suao".index(r[:1] if r[:1] in "sua" else "o")] for (r, _), f in zip(rows, found, strict=True))
        assert conversations.Trie().insert(signature) == every_edit(rows, found)


def test_trie_computes_shared_beginnings_once():
    rng = random.Random(8)
    signatures = sorted("".join(rng.choice("sua26") for _ in range(rng.randint(0, 9))) for _ in range(3000))
    trie = conversations.Trie()
    got = [trie.insert(s) for s in signatures]
    assert trie.nodes == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})
    assert got == [conversations.Trie().insert(s) for s in signatures]


def test_repaired_rows_give_the_hash(spark):
    data = table(spark, "/root/testdata/sf0.01", "conversations")
    by = defaultdict(list)
    for r in sorted(conversations.repaired_rows(data).collect(), key=lambda r: (r["conv_id"], r["place"])):
        by[r["conv_id"]].append((r["role"], r["text"], r["edit"]))
    for r in conversations.repair(data).collect():
        rows = by[r["conv_id"]]
        assert hashlib.sha256("\n".join(f"{a}:{t}" for a, t, _ in rows).encode()).hexdigest() == r["repaired_sha256"]
        assert [e for _, _, e in rows] == list(r["audit"].replace("D", ""))
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _, _ in rows))
