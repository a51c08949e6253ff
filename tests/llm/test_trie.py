"""The prefix trie against brute force, over many blocks and segments."""

import hashlib
import random
import zlib

import pytest

from veilgrid.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs long, home string"


def brute(rows):
    """Nodes by walking every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes, kids = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        leaves, saved = 0, (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        for x in kids.get(k, []):
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves or 1, saved

    out = set()
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        leaves, saved = below(k)
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def sample(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            rows.append((c, rng.choice([t, t, t, t, None]), rng.choice(["user", "bot", None, ""]), rng.choice(["a", "bé", None, "", "c" * 5]), 0, "x"))
    return rows


@pytest.mark.parametrize("segment, block", [(256, 1 << 17), (3, 5), (4, 1), (2, 40)])
def test_trie_equals_brute_force(spark, segment, block):
    rng = random.Random(segment)
    rows = sample(rng, 60, 12) + [(None, 1, "user", "lost", 0, "x"), (100, 5, "u", "z" * 9000, 0, "x"), (100, 5, "u", "z" * 9000, 0, "x")]
    rows += [(c, t, "user", "same", 0, "x") for c in range(200, 240) for t in range(15)]  # a group of copies
    found = prefixtrie.trie(spark.createDataFrame(rows, SCHEMA).repartition(7), segment, block).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute(rows)


def test_only_turnless_conversations_make_a_root(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 1, "user", "a", 0, "x")]
    assert {tuple(r) for r in prefixtrie.trie(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    assert prefixtrie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
