"""Repair of conversations against a plain search."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from paperloom.llm import dialogue

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """(turn, role, text) rows of one conversation ``(name, rows)`` after damage, in order."""
    name, rows = rows
    out = []
    for turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if name is None else name}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain_repair(rows):
    """(counts, cost, audit, text) by the least of all lists of edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        if not text.strip(WHITE):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif text.rstrip(WHITE)[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))

    following = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for new in following[state].replace("s", ""):
                cost, audit, lines = best(i, new, inserts + 1)
                options.append((cost + 2, "I" + audit, ({"u": "user:", "a": "assistant:"}[new], *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] and role[:1] in following[state]:
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    options.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                for new in following[state].replace("s", ""):
                    cost, audit, lines = best(i + 1, new, 0)
                    line = f"{ {'u': 'user', 'a': 'assistant'}[new] }:{text}"
                    options.append((cost + 2 + more, "R" + audit, (line, *lines)))
        return min(options, default=(10**9, "~", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(pair not in ("su", "ua", "au") for pair in pairs)
    counts = [faults.count(kind) for kind in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talks(seed, n, longest=14):
    rng = random.Random(seed)
    says = ["Yes.", "No!", "cut off", " \n", None, "What?\t\n", "é.\xa0", "Fine. ", ""]
    out = []
    for i in range(n):
        rows = []
        for turn in range(rng.randrange(1, longest)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(["system", "user", "tool", None, "", "assistant", "System"])
            text = rng.choice(says) if rng.random() < 0.5 else f"text {rng.randrange(30)}" + rng.choice([".", "!", ""])
            turn = rng.choice([turn, turn, turn, turn, turn, None, 2 * turn - 3, 1])
            rows += [(turn, role, text)] * rng.choice([1, 1, 1, 1, 2, 5])
        out.append((i if i else None, rows))
    return out


@pytest.mark.parametrize("bits", [1, 12])
def test_query_against_all_edits(spark, bits):
    named = talks(bits, 120) + [(500, []), (501, [(None, None, None)]), (502, [(7, "system", "Be kind.")])]
    flat = [(name, *row, 1, "x") for name, rows in named for row in rows]
    random.Random(3).shuffle(flat)
    table = spark.createDataFrame(flat, "conv_id long, turn int, role string, text string, place int, key string")
    found = {r.conv_id: tuple(r)[1:] for r in dialogue.repair_query(table.repartition(3), piece_bits=bits).collect()}
    expected = {name: plain_repair(plain_damage((name, rows))) for name, rows in named if rows}
    assert found == expected


def test_pieces_of_any_size_give_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    tokens = rng.choice([0, 1, 2, 2, 3, 3, 4, 6, 10, 11], size=300)
    end = np.array([dialogue.END])
    cost, arcs = dialogue._costs(tokens, np.array([0, 300]), end)
    bounds = np.array([0, 1, 40, 41, 300])
    after = end
    for a, b in reversed(list(zip(bounds[:-1], bounds[1:]))):
        part = dialogue._costs(tokens[a:b], np.array([0, b - a]), after)[0]
        assert part[:4].tolist() == cost[4 * a : 4 * a + 4].tolist()
        after = part[None, :4]
    letter, pointers = dialogue._ranked(arcs)
    ends, steps = dialogue._ends(np.array([0]), pointers)
    path, at = dialogue._along(np.array([0]), steps, pointers)
    assert len(at) == steps[0] and at[0] == 0 and pointers[0][at[-1]] == ends[0]
    assert (pointers[0][at[:-1]] == at[1:]).all() and (letter[at] >= 0).all()


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(i, ("user", "assistant")[(i + (rng.random() < 0.1)) % 2], f"{i % 900} said{rng.choice(['.', '.', ''])}") for i in range(3_000)]
    rows += [(5_000, "user", "again.")] * 400
    table = spark.createDataFrame([(8, *row) for row in rows] + [(9, 0, "user", "Hi.")], "conv_id long, turn int, role string, text string")
    few, many = (dialogue.repair_query(table.repartition(4), piece_bits=bits).orderBy("conv_id").collect() for bits in (5, 12))
    assert few == many
    assert few[0].duplicate > 1_000 and len(few[0].audit) >= 3_000 - 300


def test_empty_table(spark):
    table = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn int, role string, text string").limit(0)
    assert dialogue.repair_query(table).collect() == []
