"""The trie and its contracted totals against a plain dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cardwright.llm import prefix_trie as module
from cardwright.llm.prefix_trie import prefix_trie

ROW = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    if rebuild:
        made = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 9
            made[c] = convs.get(c - c % 5, [])[:h] + own[h:]
        convs = made
    # nodes as numbered entries, so that long conversations stay cheap
    nodes, key_of, ends = [(0, -1, ("", ""))], {}, defaultdict(list)
    members = [[]]
    for c in sorted(convs):
        at = 0
        members[0].append(c)
        for turn in convs[c]:
            if (at, turn) not in key_of:
                key_of[at, turn] = len(nodes)
                nodes.append((nodes[at][0] + 1, at, turn))
                members.append([])
            at = key_of[at, turn]
            members[at].append(c)
        ends[at].append(c)
    kids, leaves, saved = ([0] * len(nodes) for _ in range(3))
    out = []
    for v in reversed(range(len(nodes))):
        depth, up, turn = nodes[v]
        leaves[v] = leaves[v] or 1
        saved[v] += (len(members[v]) - 1) * len(turn[1].encode())
        if up >= 0:
            kids[up], leaves[up], saved[up] = kids[up] + 1, leaves[up] + leaves[v], saved[up] + saved[v]
        out.append((members[v][0] if members[v] else None, depth, members[up][0] if up >= 0 else None, len(members[v]), kids[v], leaves[v], saved[v], hashlib.sha256(",".join(map(str, ends[v])).encode()).hexdigest()))
    return sorted(out, key=str) if convs else []


def found(spark, rows, **options):
    return sorted(map(tuple, prefix_trie(spark.createDataFrame(rows, ROW), **options).collect()), key=str)


def test_random_conversations(spark):
    rng = np.random.default_rng(2)
    rows = [(int(c), t, ("user", "assistant")[t % 2], f"tü{rng.integers(0, 3)}") for c in rng.permutation(80) for t in range(int(rng.integers(1, 12))) if c % 10 != 5]
    for rebuild in (True, False):
        assert found(spark, rows, rebuild=rebuild) == plain(rows, rebuild)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, "b"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "x"), (2, None, None, None), (2, 3, "z", "c"), (2, 3, "a", "c"), (7, 1, "user", ""), (-3, 0, "u", "v"), (9, 5, "", "é" * 100_000)]
    assert found(spark, rows, rebuild=False) == plain(rows, False)
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(spark, rows) == plain(rows)


def test_no_conversation(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []


def test_conversations_left_without_turns(spark):
    rows = [(c, t, "user", "same") for c in (1, 2, 3, 6, 8, 11) for t in range(2)]
    want = plain(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)
    assert found(spark, rows) == want
    only = [(c, 0, "user", "x") for c in (1, 2, 3)]
    assert found(spark, only) == plain(only)


def test_long_chains_and_combs(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "IDS", 3)
    rows = [(5, t, "user", f"long {t % 7}") for t in range(700)]  # one chain
    rows += [(100 + c, t, "user", f"comb {t}") for c in range(40) for t in range(c)]  # each a prefix of the next
    rows += [(200 + c, t, "user", f"comb {t}" if t < c else "tooth") for c in range(40) for t in range(c + 1)]  # a tooth at each depth
    rows += [(300 + c, 0, "user", "same first turn") for c in range(90)]
    assert found(spark, rows, rebuild=False) == plain(rows, False)


@pytest.mark.parametrize("extra", ["id long", "parent string, kids int, pos int, a int"])
def test_other_columns_do_not_matter(spark, extra):
    rows = [(c, t, "user", f"x{t}") for c in range(6) for t in range(c)]
    table = spark.createDataFrame([(*r, *(None for _ in extra.split(","))) for r in rows], f"{ROW}, {extra}")
    assert sorted(map(tuple, prefix_trie(table).collect()), key=str) == plain(rows)
