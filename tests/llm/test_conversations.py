"""Conversation repair against a shortest path over all edits, and by hand."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from migrata.llm import conversations as c

SPACE = " \t\n\v\f\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        if kind == 0:
            continue
        if kind == 4:
            role = "user"
        spoilt = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, tie, role, spoilt)] * (2 if kind == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _cheapest(rows):
    """Least (cost, initials) by a search over (row, initials so far of the result); the result as well."""
    faults = _faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, have, made = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(have):
            return cost, audit, made
        # what may follow depends on the last initial and on whether there is one
        key = (i, have[-1:] if len(have) > 1 or have != "s" else "s")
        if key in done:
            continue
        done.add(key)

        def go(price, letter, role, text, step):
            new = have + role[:1]
            if role and not (new in ("s", "u", "su") or have[-1:] + role[:1] in ("ua", "au")):
                return
            heapq.heappush(heap, (cost + price, audit + letter, i + step, new if role else have, made + (((role, text),) if role else ())))

        if len(audit) < 2 * len(rows) + 4:
            for role in ("user", "assistant"):
                go(3, "I", role, "", 0)
        if i < len(rows):
            role, text = rows[i]
            go(4, "D", "", "", 1)
            if faults[i] in ("", "truncated"):
                extra = 3 if faults[i] else 0
                if role[:1] in ("s", "u", "a"):
                    go(extra, "K", role, text, 1)
                for r in ("user", "assistant"):
                    go(3 + extra, "R", r, text, 1)


def _truth(table):
    """The contract's columns by plain loops."""
    alive, out = {}, {}
    for row in _damage(table):
        alive.setdefault(row[0], []).append(row)
    for conv in {r[0] for r in table}:
        rows = sorted(alive.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        pairs = [(r[3], r[4]) for r in rows]
        turns = {r[1] for r in rows} - {None}
        faults = _faults(pairs)
        cost, audit, made = _cheapest(pairs) if rows else (0, "", ())
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def _got(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
            for r in c.report(df).collect()}


def _all_edits(rows, longest):
    """Every list of edits written out: least (cost, initials)."""
    faults = _faults(rows)
    best = None
    for n in range(longest + 1):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            for roles in itertools.product("ua", repeat=sum(x in "IR" for x in letters)):
                free, i, cost, have = iter(roles), 0, 0, ""
                for x in letters:
                    if x == "I":
                        have, cost = have + next(free), cost + 3
                        continue
                    if x == "D":
                        cost += 4
                    else:
                        if faults[i] in ("blank", "duplicate"):
                            break
                        cost += (3 if x == "R" else 0) + (3 if faults[i] else 0)
                        have += next(free) if x == "R" else rows[i][0][:1] or "-"
                    i += 1
                else:
                    if LEGAL.fullmatch(have):
                        best = min(best or (cost, "".join(letters)), (cost, "".join(letters)))
    return best


def test_automaton_against_every_list_of_edits():
    texts = {0: "fine.", 1: " ", 3: "open"}
    for n in (1, 2, 3):
        for codes in itertools.product(itertools.product("suax", (0, 1, 3)), repeat=n):
            if n == 3 and random.Random(str(codes)).random() > 0.04:
                continue
            rows = [({"s": "system", "u": "user", "a": "assistant", "x": "tool"}[r], texts[f] if f == 1 else f"{k} {texts[f]}") for k, (r, f) in enumerate(codes)]
            text = "".join(c.SYMBOLS["suax".index(r) * 4 + f] for r, f in codes)
            (got,) = c.repairs(iter([text[::-1]]))
            assert got == _all_edits(rows, n + 3), codes


def test_suffixes_are_shared():
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice(c.SYMBOLS[:12]) for _ in range(rng.randrange(1, 9)))[::-1] for _ in range(300)})
    assert list(c.repairs(iter(texts))) == [next(c.repairs(iter([t]))) for t in texts]


def _table(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "What is it?", "", " \n", "Done!", "and so", "Ok. ", None, "é…", "x" * 40 + "."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 9)):
            t = None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * 2
            rows.append((conv, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_report_against_plain_search(spark):
    rows = _table(5, 150)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert _got(df) == _truth(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert _got(df) == _truth(rows)


def test_edge_tables(spark):
    long = [(1, t, ("user", "assistant")[t % 2], f"row {t}.") for t in range(4000)]
    names = "conv_id long, turn long, role string, text string, conv long, audit string, signature int, c int"
    df = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in long], names)
    (row,) = c.report(df).collect()
    assert row["conv_id"] == 1 and len(row["audit"]) >= 3000
    assert c.report(spark.createDataFrame([], names)).count() == 0
    # the only row is dropped by the damage rule
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (row,) = c.report(spark.createDataFrame([(lost, 0, "user", "hello.")], names.split(", conv ")[0])).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Go on"), (2, 0, "user", "A?"), (2, 1, "assistant", "B."), (2, 2, "assistant", "B."), (3, 0, "tool", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in c.repaired(df).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv in (1, 2):
        assert LEGAL.fullmatch("".join(r[0] for r, _ in got[conv]))
        assert tuple(got[conv]) == _cheapest([r[2:] for r in rows if r[0] == conv])[2]
    assert 3 not in got
