"""Repair and trie of conversations against brute force, with nulls, empty and long texts, ties, repeats and other columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from tesselar.llm import trie as T
from tesselar.llm.repair import cheapest, repair
from tesselar.llm.trie import prefix_trie

DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, kind int, n string, key int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows_of(spark):
    """Shared prefixes, null and repeated turns, rows that stand twice, faults and odd roles; conversation 30 has 300 turns."""
    rng = random.Random(3)
    out = []
    for c in [None, *range(60), -7, 10**12]:
        if c == 15:
            continue  # a base that is absent
        for t in range(300 if c == 30 else rng.randrange(0, 9)):
            turn = rng.choice([t, t, t, t + 2, None, 1])
            text = rng.choice(["Yes.", "No!", "so what?", "cut", "", " \t", None, f"own {c} {t}.", "é?", "x" * 20_000 + "."])
            out.append((c, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]) if c and c % 3 else ["user", "assistant"][t % 2], text))
    out += out[:40:3]
    rng.shuffle(out)
    return out, spark.createDataFrame([(*r, 1, "x", 2) for r in out], SCHEMA).repartition(3)


def repaired(rows):
    convs, ids = defaultdict(list), set()
    for c, t, r, x in rows:
        ids.add(c)
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        convs[c] += [(t, "user" if hit == 4 else r, x)] * {0: 0, 3: 2}.get(hit, 1)
    name, out = {"u": "user", "a": "assistant"}, {}
    for c in ids:
        turns = sorted(convs[c], key=lambda z: (z[0] is not None, z[0] or 0, hashlib.sha256((z[1] + "\0" + z[2]).encode()).digest()[:16]))
        known = [t for t, _, _ in turns if t is not None]
        seen, faults = set(), []
        for _, r, x in turns:
            bare = x.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((r, x))
        # All edits backwards: of every state the cheapest cost and the least audit, with what they make.
        best, n = {}, len(turns)
        for i in range(n, -1, -1):
            heap = [(0, "", st, ()) for st in ("", "a")] if i == n else []
            for st in ("", "s", "u", "a") if i < n else ():
                due = "a" if st == "u" else "u"
                (_, r, x), f = turns[i], faults[i]
                more = 5 * (f == "t")
                options = [(2, "D", st, ())]
                if f not in ("b", "d"):
                    options += [(more, "K", due, (f"{r}:{x}",))] * (r[:1] == due) + [(more, "K", "s", (f"{r}:{x}",))] * (r[:1] == "s" and st == "") + [(1 + more, "R", due, (f"{name[due]}:{x}",))]
                for cost, edit, to, made in options:
                    rest = best[i + 1, to]
                    heap.append((cost + rest[0], edit + rest[1], st, made + rest[2]))
            heapq.heapify(heap)
            while heap:
                cost, audit, st, made = heapq.heappop(heap)
                if (i, st) in best:
                    continue
                best[i, st] = cost, audit, made
                for before in ("", "s", "u", "a"):
                    due = "a" if before == "u" else "u"
                    if due == st:
                        heapq.heappush(heap, (cost + 5, "I" + audit, before, (f"{name[due]}:", *made)))
        cost, audit, made = best[0, ""]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *map(faults.count, "bdt"), illegal, cost, audit, sha("\n".join(made)))
    return out


def test_repair(spark):
    for rows, table in (rows_of(spark), (None, spark.read.parquet(f"{DIR}/conversations.parquet"))):
        rows = rows or [tuple(r) for r in table.collect()]
        got = repair(table).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == repaired(rows) and len(got) == len({r[0] for r in rows})
    assert repair(table.limit(0)).count() == 0


def test_repair_of_one_dropped_row(spark):
    t = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert [tuple(r) for r in repair(spark.createDataFrame([(1, t, "user", "x")], "conv_id long, turn long, role string, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_cheapest():
    assert cheapest(b"") == (0, b"")
    assert cheapest(bytes([1])) == (2, b"D")  # a system turn alone is deleted
    assert cheapest(bytes([2, 3])) == (0, b"KK")
    assert cheapest(bytes([3, 2])) == (2, b"RR")
    assert cheapest(bytes([2, 2, 3])) == (2, b"DKK")
    assert cheapest(bytes([2 + 16, 3])) == (4, b"DD")


def trie(rows):
    convs, members, kids, out = defaultdict(list), defaultdict(list), defaultdict(list), []
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [z[2:] for z in sorted(v, key=lambda z: z[:2])] for c, v in convs.items()}
    whole = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(convs.get(base, [])[:h] + v[h:])
    for c, v in sorted(whole.items()):
        for k in range(len(v) + 1):
            members[v[:k]].append(c)
    for k in members:
        kids[k[:-1]] += [k] if k else []
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k], saved[k] = sum(leaves[q] for q in kids[k]) or 1, own + sum(saved[q] for q in kids[k])
        ends = [c for c in members[k] if len(whole[c]) == len(k)]
        out.append((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 100)
    rows, table = rows_of(spark)
    rows = sorted({r[:2]: r for r in rows}.values(), key=str)  # one row for a turn: their order is fixed then
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    for rows, table in ((rows, table), (None, spark.read.parquet(f"{DIR}/conversations.parquet"))):
        rows = rows or [tuple(r) for r in table.collect()]
        assert sorted((tuple(r) for r in prefix_trie(table).collect()), key=str) == trie(rows)
    assert prefix_trie(table.limit(0)).count() == 0


def test_trie_of_copies_repeats_and_turnless(spark):
    """Copies end at one node, rows that come twice are two turns, and a conversation whose turns are all left out is at the root."""
    short = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5)
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1400, 5) for t in range(3)] + [(short, 0, "user", "x"), (short, 0, "user", "x")]
    got = sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=lambda r: r[1])
    ends = ",".join(map(str, range(1000, 1400, 5)))
    assert [r[:7] for r in got] == [(short, 0, None, 81, 1, 1, 79 * 6), (1000, 1, short, 80, 1, 1, 79 * 6), (1000, 2, 1000, 80, 1, 1, 79 * 4), (1000, 3, 1000, 80, 0, 1, 79 * 2)]
    assert [r[7] for r in got] == [sha(str(short)), sha(""), sha(""), sha(ends)]
