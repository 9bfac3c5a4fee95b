import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import q_turn_repair, turn_repair

SPACE = " \t\n\x0b\x0c\r"
GOAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.rstrip(SPACE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_way(rows):
    """All edits of all rows with up to two added turns before each and at the end, read by the rule."""
    found = []
    fault = faults(rows)
    adds = [(), ("I",), ("I", "I")]
    per_row = [[(*a, e) for a in adds for e in ("D", "K", ("R", "user"), ("R", "assistant"))] for _ in rows]
    for ways in itertools.product(*per_row, adds):
        for guess in itertools.product(("user", "assistant"), repeat=sum(x.count("I") for x in ways)):
            names, cost, audit, made, k, ok = iter(guess), 0, "", [], 0, True
            for edit in itertools.chain(*ways):
                audit += edit[0]
                if edit == "I":
                    cost += 3
                    made.append((next(names), ""))
                    continue
                (role, text), bad = rows[k], fault[k]
                k += 1
                if edit == "D":
                    cost += 4
                    continue
                if bad in ("blank", "duplicate"):
                    ok = False
                    break
                cost += 3 * (bad == "truncated") + (0 if edit == "K" else 3)
                made.append((role if edit == "K" else edit[1], text))
            if ok and all(r for r, _ in made) and GOAL.fullmatch("".join(r[0] for r, _ in made)):
                found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in made)))
    return min(found)


def row_by_row(rows):
    """The least (cost, audit) for what stands last, one row after the other, with plain strings."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def add(table):
        for _ in range(3):
            for last, (cost, audit, made) in list(table.items()):
                new = (cost + 3, audit + "I", (*made, ({"u": "user", "a": "assistant"}[after[last]], "")))
                if after[last] not in table or new[:2] < table[after[last]][:2]:
                    table[after[last]] = new
        return table

    for (role, text), bad in zip(rows, faults(rows)):
        new = {}

        def offer(last, way):
            if last not in new or way[:2] < new[last][:2]:
                new[last] = way

        for last, (cost, audit, made) in add(dict(best)).items():
            offer(last, (cost + 4, audit + "D", made))
            if bad in ("blank", "duplicate"):
                continue
            more = 3 * (bad == "truncated")
            offer(after[last], (cost + 3 + more, audit + "R", (*made, ({"u": "user", "a": "assistant"}[after[last]], text))))
            if last + role[:1] in ("s", "u", "su", "ua", "au") and role:
                offer(role[0], (cost + more, audit + "K", (*made, (role, text))))
        best = new
    done = add(dict(best))
    cost, audit, made = min((done[x] for x in ("", "a") if x in done), key=lambda w: w[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)


def solved(rows):
    symbols = [0 if f in ("blank", "duplicate") else 1 + 2 * (" sua".find(r[:1]) if r[:1] in ("s", "u", "a") else 0) + (f == "truncated") for (r, _), f in zip(rows, faults(rows))]
    cost, audit = turn_repair.cheapest([(s, len(list(g))) for s, g in itertools.groupby(symbols)])
    return cost, audit, "\n".join(f"{r}:{t}" for _, r, t in turn_repair.edited(audit, iter(rows)))


def random_rows(rng, n, few=False):
    texts = ["", " ", "a.", "b?", "c", "d! ", "e \n"] + ([] if few else [f"t{k}." for k in range(200)])
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(n)]


def test_against_every_way():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 2), few=True)
        assert row_by_row(rows) == every_way(rows) == solved(rows)
    for _ in range(3):
        rows = random_rows(rng, 3)
        assert every_way(rows) == solved(rows)


def test_against_row_by_row():
    rng = random.Random(2)
    for _ in range(400):
        rows = random_rows(rng, rng.randint(0, 40))
        assert row_by_row(rows) == solved(rows)
    for n in (1, 2, 3, 7, 64, 100, 257):
        for role in ("system", "user", "assistant", "tool"):
            for mark in (".", ""):
                rows = [(role, f"{k}{mark}") for k in range(n)]
                assert row_by_row(rows) == solved(rows)


def test_a_very_long_run():
    cost, audit = turn_repair.cheapest([(5, 1_000_001)])
    assert len(audit) == audit.count("K") + audit.count("D") + audit.count("R") + audit.count("I") and len(audit.replace("I", "")) == 1_000_001
    assert cost == 3 * (audit.count("R") + audit.count("I")) + 4 * audit.count("D")


def expected(rows):
    """The contract, plainly, over (conv_id, turn, role, text)."""
    by: dict = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = by.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        mine += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        pairs = [(r, t) for _, r, t in mine]
        turns = {t for t, _, _ in mine if t is not None}
        found = faults(pairs)
        cost, audit, text = row_by_row(pairs)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs)), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("which", ["data", "larger"])
def test_whole_table(spark, request, which):
    folder = request.getfixturevalue(which)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in q_turn_repair.query(spark, folder).collect()), key=str)
    assert got == expected(rows)


def test_nulls_ties_repeats_and_extra_columns(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, -4]), rng.choice([None, 0, 1, 1, 2, 5, 90]), rng.choice([None, "user", "assistant", "system", "", "usher"]), rng.choice([None, "", "x.", "y", "z \t", "é?", "\x0b", "long " * 900 + "."])) for _ in range(150)]
    rows += [(50, k, "user", "same.") for k in range(40)] + [(60, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, fault string, place int, audit string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in q_turn_repair.query(spark, str(tmp_path)).collect()), key=str)
    assert got == expected(rows)


def test_repaired_turns_follow_the_rule(spark):
    rows = [("a", 0, "assistant", "Hi."), ("a", 1, "assistant", "Cut"), ("a", 2, "user", "Who?"), ("b", 0, "user", " "), (None, 0, "system", "Be kind.")]
    got = turn_repair.repaired_turns(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.conv_id or "", r.place)):
        by.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    for conv in ("a", "b", None):
        source = [(r, t) for c, _, r, t in rows if c == conv]
        assert "\n".join(f"{r}:{t}" for _, r, t in by.get(conv, [])) == every_way(source)[2]


def test_empty_table(spark):
    assert turn_repair.repair_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
