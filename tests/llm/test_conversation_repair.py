"""Operator 13 against uniform-cost search over whole audits, in memory and in pieces, and its report against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from folia.llm import conversation_repair as R

GRAMMAR = re.compile(r"(s?(ua)+)?")


def searched(symbols):
    """Cost and least audit: partial audits in order of (cost, letters), told apart only by what they have built so far."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, used, built = heapq.heappop(heap)
        # What may follow depends on the last letter only.
        if (used, built[-1:]) in seen:
            continue
        seen.add((used, built[-1:]))
        if used == len(symbols) and GRAMMAR.fullmatch(built):
            return cost, audit
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[built[-1:]]
        steps = [(3, "I", used, x) for x in "ua" if x in follow]
        if used < len(symbols):
            s = symbols[used]
            more = 3 if s.isupper() else 0
            steps.append((4, "D", used + 1, ""))
            if s != "x":
                steps += [(more, "K", used + 1, s.lower())] if s.lower() in follow else []
                steps += [(3 + more, "R", used + 1, x) for x in "ua" if x in follow]
        for c, letter, at, x in steps:
            heapq.heappush(heap, (cost + c, audit + letter, at, built + x))


def test_cheapest_edits_of_every_short_conversation():
    for n in range(5):
        for symbols in itertools.product("xsuaoSUA", repeat=n):
            assert R.cheapest("".join(symbols)) == searched(symbols), symbols


def test_cheapest_edits_of_longer_conversations():
    rng = random.Random(13)
    for _ in range(300):
        symbols = "".join(rng.choice("xsuaoUA" if rng.random() < 0.5 else "ua") for _ in range(rng.randint(5, 120)))
        assert R._cheapest(symbols) == searched(symbols)


def test_pieces_spell_the_same_audit():
    rng = random.Random(7)
    for _ in range(300):
        symbols = "".join(rng.choice("xsuaoUA" if rng.random() < 0.7 else "ua") for _ in range(rng.randint(1, 60)))
        cuts = sorted(rng.sample(range(1, len(symbols)), min(len(symbols) - 1, rng.randint(0, 6)))) if len(symbols) > 1 else []
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        cost, rest = R.border_costs([R.costs_between(p) for p in parts])
        state, audit = 0, ""
        for part, exits in zip(parts, rest[1:]):
            ends, audits = R.spelled(part, exits)
            state, audit = ends[state], audit + audits[state]
        assert (cost, audit + ["", "II", "I", ""][state]) == R._cheapest(symbols)


def plain(rows):
    """The contract's report of rows (conv_id, turn, role, text), in plain Python."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            shown = [" " if x is None else str(x) for x in (c, turn)]
            kind = zlib.crc32(":".join(shown).encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in mine:
            inked = text.strip("\x20\t\n\x0b\x0c\r")
            faults.append("blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [r[0] for r in mine if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        symbols = ["x" if f in ("blank", "duplicate") else (c if (c := r[1][:1]) in ("s", "u", "a") and c else "o") for r, f in zip(mine, faults)]
        symbols = [s.upper() if f == "truncated" else s for s, f in zip(symbols, faults)]
        cost, audit = searched(symbols)
        built, k, done = "", 0, []
        for letter in audit:
            nxt = "assistant" if built[-1:] == "u" else "user"
            if letter == "I":
                done.append(f"{nxt}:")
                built += nxt[0]
                continue
            if letter != "D":
                role = nxt if letter == "R" else mine[k][1]
                done.append(f"{role}:{mine[k][2]}")
                built += role[0]
            k += 1
        assert GRAMMAR.fullmatch(built)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for t in range(rng.choice([1, 2, 5, 9])):
            text = rng.choice(["Hello.", "Yes!", "no end", " \n", "", None, "a b c? ", "naïve ends. ", f"turn {t}."])
            rows.append((conv, rng.choice([None, t, t, 3 * t]), rng.choice(["system", "user", "assistant", "tool", "", None, "User"] if rng.random() < 0.4 else ["user", "assistant"]), text))
    rows += [rows[5], rows[5], (500, 3, "user", "x" * 200_000)]
    rows += [(700, t, ("user", "assistant")[t % 2], rng.choice(["Same.", f"text {t}.", f"cut {t}"])) for t in range(700)]
    return rows


@pytest.mark.parametrize(("max_rows", "piece"), [(4096, 4096), (20, 7), (2, 3), (0, 1)])
def test_report(spark, max_rows, piece):
    rows = odd_rows()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as kind", "true as dropped").repartition(3)
    found = R.report(R.damaged(table), max_rows=max_rows, piece=piece).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_report_of_the_given_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, R.query(spark, small).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("max_rows", [4096, 2])
def test_repaired_turns(spark, max_rows):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", " "), (2, 0, "assistant", "So."), (2, 1, "user", "Cut"), (3, 0, "tool", "")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = sorted(map(tuple, R.repaired(table, max_rows=max_rows, piece=2).collect()))
    assert found[:2] == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Again.")]
    for conv in (1, 2):
        assert GRAMMAR.fullmatch("".join(r[3][0] for r in found if r[0] == conv))
    assert not [r for r in found if r[0] == 3]
