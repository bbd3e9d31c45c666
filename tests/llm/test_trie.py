import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check_queries import canonical
from hourloom.llm import queries, trie


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:trie.DIGEST_BYTES]


def plain_sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, role, digest(role, text)), (role, text)))
    return {c: [t for _, t in sorted(turns, key=lambda x: x[0])] for c, turns in own.items()}


def plain_branched(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def plain_trie(seqs):
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.add((len(p), min(m), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.data())
def test_extents_by_range_minima(shared, data):
    shared = np.array([-1, *shared])
    at = data.draw(st.integers(0, len(shared) - 1))
    depth = data.draw(st.integers(0, 5))
    left, right = trie.extents(trie._minima(shared), np.array([at]), np.array([depth]))
    low = high = at
    while low > 0 and shared[low] >= depth:
        low -= 1
    while high + 1 < len(shared) and shared[high + 1] >= depth:
        high += 1
    assert (left[0], right[0]) == (low, high)


ROWS = "conv_id long, turn long, role string, text string"


def hard_rows():
    """A first turn that most share, copies, prefixes of others, odd values, a long conversation."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if c % 3 else f"t{t}-{c * (t > 2)}")
            for c in range(60) for t in range(c % 12)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)]
    rows += [(200, t, "user", "x" * t) for t in range(300)] + [(205, t, "user", "x" * t) for t in range(280)]
    rows += [(None, 1, "user", "no key"), (300, None, None, None), (300, None, "user", "é한"), (300, 0, "user", ""),
             (301, 5, "a", "b"), (301, 5, "a", "b"), (301, 5, "a", "c"), (-3, 0, "user", "t0"), (-7, 1, "user", "t0"),
             (-5, 0, "user", "t0"), (2**40, 0, "user", "t0"), (302, 0, "us", "ert"), (303, 0, "user", "t")]
    return rows


@pytest.mark.parametrize("part", [2 << 20, 4000, 1000])
def test_against_plain_trie(spark, monkeypatch, part):
    monkeypatch.setattr(trie, "PART_BYTES", part)
    monkeypatch.setattr(trie, "CANDIDATES", part // 10)
    rows = spark.createDataFrame(hard_rows(), ROWS).selectExpr("*", "turn as depth", "role as __t", "text as __turns")
    own = plain_sequences(hard_rows())
    for seqs, build in ((own, trie.sequences(rows)), (plain_branched(own), trie.branched(trie.sequences(rows)))):
        got = trie.prefix_trie(build).collect()
        assert len(got) == len({tuple(r)[:8] for r in got})
        assert {tuple(r)[:8] for r in got} == plain_trie(seqs)
    ranked = trie.in_order(trie.sequences(rows))
    assert ranked.select("__part").distinct().count() > 3 or part > 4000


def test_members_are_intervals(spark, monkeypatch):
    monkeypatch.setattr(trie, "PART_BYTES", 3000)
    rows = spark.createDataFrame(hard_rows(), ROWS)
    own = plain_sequences(hard_rows())
    order = sorted(own, key=lambda c: ([digest(*t) for t in own[c]], c))
    for r in trie.prefix_trie(trie.sequences(rows)).collect():
        inside = order[r.first_rank:r.first_rank + r.n_convs]
        assert min(inside) == r.conv_id and len({tuple(own[c][:r.depth]) for c in inside}) == 1


def test_no_rows_no_turns(spark):
    rows = spark.createDataFrame(hard_rows(), ROWS)
    assert trie.prefix_trie(trie.branched(trie.sequences(rows.limit(0)))).count() == 0
    one = spark.createDataFrame([(6, 0, "user", "a")], ROWS)  # its base is absent, its own turn is among the first h
    assert [tuple(r)[:8] for r in trie.prefix_trie(trie.branched(trie.sequences(one))).collect()] == list(
        plain_trie(plain_branched(plain_sequences([(6, 0, "user", "a")]))))


def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    mine = canonical(queries.QUERIES["op13_prefix_trie"](spark, folder).toPandas())
    assert mine == canonical(con.sql(queries.ORACLE["op13_prefix_trie"]).df())
