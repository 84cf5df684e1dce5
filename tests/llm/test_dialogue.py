"""Conversation repair against a search over edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from meridex.llm.dialogue import REPAIR_SQL, damage, repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FIELDS = "conv_id bigint, turn bigint, role string, text string, i int, key string, fault string, copy int"


def broken(rows):
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            yield from [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)


def search(rows):
    """gaps, counts, cost, audit and hash of one conversation's rows: cheapest first, then the least audit."""
    rows = sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
    faults, seen = [], set()
    for _, r, x in rows:
        s = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
        faults.append("blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else "")
        seen.add((r, x))
    first = [r[:1] or " " for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    heap, best, done = [(0, "", 0, "", ())], None, {}
    while heap:
        cost, audit, i, g, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and g in ("", "a"):
            best = best or (cost, audit, lines)
            continue
        if done.setdefault((i, g), (cost, audit)) < ((cost,) if len(rows) <= 6 else (cost, audit)):
            continue  # of short conversations every cheapest way is followed, of longer ones the least audit of each state
        to = NEXT[g]
        role = {"u": "user", "a": "assistant"}[to]
        if not audit.endswith("III"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, g, lines))
            if faults[i] in ("truncated", ""):
                more = cost + 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (more + 3, audit + "R", i + 1, to, (*lines, f"{role}:{rows[i][2]}")))
                if first[i] == to or (g == "" and first[i] == "s"):
                    heapq.heappush(heap, (more, audit + "K", i + 1, first[i], (*lines, f"{rows[i][1]}:{rows[i][2]}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    sha = hashlib.sha256("\n".join(best[2]).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], sha)


def conversations():
    rng, out = random.Random(6), []
    for c in range(120):
        turns = sorted(rng.choices([None, *range(rng.choice((4, 12)))], k=rng.randrange(1, 9)), key=lambda t: (t is not None, t or 0))
        for t in turns:
            out.append((c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "No", "?", "", " \n", None, "So.\n", "é. ", "Yes."])))
    out += [(None, 1, "user", "A?"), (None, 2, "assistant", "B."), (None, None, "user", "C."), (500, None, None, None), (501, 10**12, "user", "far."), (501, -(10**12), "assistant", "near.")]
    out += [(600, t, ("user", "assistant")[t % 2], f"{t % 37}.") for t in range(700)]  # longer than a run
    return out + [(601, 3, "user", "same.")] * 600


@pytest.fixture(scope="module")
def rows():
    return conversations()


def expected(rows):
    out = {c: [] for c, *_ in rows}
    for c, t, r, x in broken(rows):
        out[c].append((t, r, x))
    return {c: search(v) for c, v in out.items()}


@pytest.mark.parametrize("run", [256, 3])
def test_against_search(spark, store, rows, run):
    d = spark.createDataFrame([(*r, 1, "k", "f", 2) for r in rows], FIELDS)
    got = {r.conv_id: tuple(r)[1:] for r in repair(damage(d), d, store, run).collect()}
    assert got == expected(rows)


def test_empty_and_dropped(spark, store):
    none = spark.createDataFrame([], FIELDS)
    assert repair(damage(none), none, store).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    d = spark.createDataFrame([(lost, 0, "user", "gone.", 1, "k", "f", 2)], FIELDS)
    assert [tuple(r) for r in repair(damage(d), d, store).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_sql(rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    few = [r for r in rows if r[0] is None or r[0] < 600]
    con.register("c", pd.DataFrame(few, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("create view conversations as select * from c")
    assert {r[0]: r[1:] for r in con.sql(REPAIR_SQL).fetchall()} == expected(few)
