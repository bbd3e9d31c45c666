"""Operator 13: prefix trie of conversations from sorted neighbours and range minima."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import ScaleSettings
from hourloom.llm.common import small_batches, stored
from hourloom.operators.scale import attach

#: A turn is known by so many bytes of a SHA-256 digest.
DIGEST_BYTES = 16
#: Bytes of the sequences that one task puts into a table of range minima, about.
PART_BYTES = 2 << 20
#: Candidate prefixes whose extents are searched at once.
CANDIDATES = 1 << 20

_NODE = ("depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, first_rank long")
_FOUND = _NODE + ", __ident binary, __up binary, __part int, __n_ends long, __ends string"
_NONE = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """One row per conversation: its key and __turns, for each turn its digest and its text's bytes.

    Turns are in order of turn, NULL first, then of role and digest; a repeated row is a repeated
    turn. NULL roles and texts are empty. Rows without a key are no conversation. Only digests are
    shuffled, not texts; a conversation is one row, so about 24 bytes a turn have to fit into it.
    """
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(
        F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * DIGEST_BYTES))
    turns = rows.filter(F.col(key).isNotNull()).select(F.col(key), F.struct(
        F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"),
        F.octet_length(said).cast("long").alias("bytes")).alias("__t"))
    listed = turns.groupBy(key).agg(F.sort_array(F.collect_list("__t")).alias("__t"))
    return listed.select(key, F.transform("__t", lambda t: F.struct(
        t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("__turns"))


def branched(own: DataFrame, key: str = "conv_id", family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that begin like another of their family and go on with their own turns.

    Conversation c takes its first h = crc32(decimal c) mod `heads` turns from conversation c - c mod
    `family` (all it has, if fewer; none, if there is no such), and then its own after its first h.
    """
    c = F.col(key)
    base = own.filter(c % family == 0).select(
        c.alias("__base"), F.slice("__turns", 1, heads - 1).alias("__head"))
    h = (F.crc32(c.cast("string")) % heads).cast("int")
    joined = own.withColumns({"__base": c - c % family, "__h": h}).join(base, "__base", "left")
    head = F.when(F.col("__h") > 0, F.slice("__head", F.lit(1), F.col("__h")))
    rest = F.slice("__turns", F.col("__h") + 1, F.greatest(F.size("__turns"), F.lit(1)))
    return joined.select(key, F.concat(F.coalesce(head, F.slice("__turns", 1, 0)), rest).alias("__turns"))


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays share; -1 if one is missing."""
    first_other = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.coalesce(F.when(first_other == 0, F.size(a)).otherwise(first_other - 1).cast("long"), F.lit(-1).cast("long"))


def _minima(values: np.ndarray) -> np.ndarray:
    """Row k holds the least of 2^k values from each place on."""
    rows = [values]
    for k in range(len(values).bit_length() - 1):
        low, half = rows[-1].copy(), 1 << k
        np.minimum(low[:-half], rows[-1][half:], out=low[:-half])
        rows.append(low)
    return np.array(rows)


def extents(minima: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share `depth` turns with row `at`: on either side, halving steps over
    the range minima of the rows' shared lengths (element i: rows i - 1 and i)."""
    n, left, right = minima.shape[1], at.copy(), at.copy()
    for k in range(len(minima) - 1, -1, -1):
        step = 1 << k
        back = left - step
        left = np.where((back >= 0) & (minima[k, np.maximum(back + 1, 0).clip(max=n - 1)] >= depth), back, left)
        on = right + step
        right = np.where((on < n) & (minima[k, np.minimum(right + 1, n - 1)] >= depth), on, right)
    return left, right


def _least(minima: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    k = np.frexp((right - left + 1).astype(float))[1] - 1
    return np.minimum(minima[k, left], minima[k, right - (1 << k) + 1])


def _shared_lengths(keys: list[bytes], sizes: np.ndarray, before: int) -> np.ndarray:
    out = np.empty(len(keys), np.int64)
    out[0] = before
    for i in range(1, len(keys)):
        a, b = keys[i - 1], keys[i]
        if a == b:
            out[i] = sizes[i]
            continue
        n = min(len(a), len(b))
        other = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
        out[i] = (other[0] if len(other) else n) // DIGEST_BYTES
    return out


def _idents(key: bytes, upto: int) -> list[bytes]:
    """A digest for each of the first prefixes of a sequence, the empty one included."""
    chain = hashlib.sha256()
    out = [chain.digest()]
    for d in range(upto):
        chain.update(key[d * DIGEST_BYTES:(d + 1) * DIGEST_BYTES])
        out.append(chain.digest())
    return out


class _Part:
    """Consecutive sequences in order, and what they share with the rows before and after them."""

    def __init__(self, group: pa.Table):
        number, before, after, offset = (group.column(c)[0].as_py() for c in ("__part", "__before", "__after", "__offset"))
        turns = group.column("__turns").combine_chunks()
        turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
        marks = np.asarray(turns.offsets).astype(np.int64)
        cells = turns.values  # offsets count from the start of it
        raw = b"".join(cells.field("digest").to_pylist())
        size_of = np.asarray(cells.field("bytes").fill_null(0)).astype(np.int64)
        convs = np.asarray(group.column("__key")).astype(np.int64)
        keys = [raw[DIGEST_BYTES * a:DIGEST_BYTES * b] for a, b in zip(marks, marks[1:])]
        order = sorted(range(len(keys)), key=lambda i: (keys[i], convs[i]))
        self.keys = [keys[i] for i in order]
        order = np.array(order)
        self.number, self.before, self.after, self.offset = number, before, after, offset
        self.convs, self.sizes = convs[order], np.diff(marks)[order]
        #: Bytes of the first k turns of row i: total[place[i] + k].
        self.place = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.total = np.zeros(int((self.sizes + 1).sum()), np.int64)
        for at, i in zip(self.place, order):
            a, b = marks[i], marks[i + 1]
            np.cumsum(size_of[a:b], out=self.total[at + 1:at + 1 + b - a])
        self.lcp = _shared_lengths(self.keys, self.sizes, before)
        self.next = np.append(self.lcp[1:], after)
        self.n = len(self.keys)
        self.leaves = np.append(0, np.cumsum(self.next < self.sizes))
        common = np.maximum(self.lcp, 0)
        self.saved = np.append(0, np.cumsum(self.total[self.place + common]))
        #: Places with a shared length, in order of length, then place.
        self.by_length = np.sort(self.lcp * (self.n + 1) + np.arange(self.n))
        same = (self.lcp == self.sizes) & (np.append(-1, self.sizes[:-1]) == self.sizes)
        same[0] = False
        starts = np.flatnonzero(~same)
        self.run = np.repeat(np.append(starts[1:], self.n), np.diff(np.append(starts, self.n)))
        self.lcp_minima, self.conv_minima = _minima(self.lcp), _minima(self.convs)
        self.first = _idents(self.keys[0], max(before, 0))
        self.last = _idents(self.keys[-1], max(after, 0))

    def _equal(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
        low = depth * (self.n + 1)
        return np.searchsorted(self.by_length, low + right, "right") - np.searchsorted(self.by_length, low + left)

    def _open(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Whether members lie in another part too: 1 before, 2 after this one."""
        return ((left == 0) & (self.before >= depth)) + 2 * ((right == self.n - 1) & (self.after >= depth))

    def _ident(self, opened: int, depth: int) -> bytes | None:
        return None if not opened else self.first[depth] if opened & 1 else self.last[depth]

    def nodes(self, at: np.ndarray, depth: np.ndarray) -> dict[str, list | np.ndarray]:
        left, right = extents(self.lcp_minima, at, depth)
        mine = left == at  # one candidate reports: the first member here
        at, depth, right = at[mine], depth[mine], right[mine]
        opened = self._open(at, right, depth)
        above = np.maximum(depth - 1, 0)
        up_left, up_right = extents(self.lcp_minima, at, above)
        up_open = np.where(depth > 0, self._open(up_left, up_right, above), 0)
        begins = self.lcp[at] < depth  # its first member of all
        shared = right - at + 1 - begins
        saved = (self.saved[right + 1] - self.saved[at + begins]) - shared * self.total[self.place[at] + above]
        n_ends = np.where(self.sizes[at] == depth, self.run[at] - at, 0)
        joined = {i: ",".join(map(str, self.convs[at[i]:at[i] + n_ends[i]].tolist())) for i in np.flatnonzero(n_ends)}
        whole = opened == 0
        children = self._equal(at, right, depth) + np.where(whole, 1 - n_ends, 0)
        parent = _least(self.conv_minima, up_left, up_right).tolist()
        return {
            "depth": depth.astype(np.int32), "conv_id": _least(self.conv_minima, at, right),
            "parent_conv_id": [p if d > 0 and not o else None for p, d, o in zip(parent, depth.tolist(), up_open.tolist())],
            "n_convs": right - at + 1, "n_children": children, "n_leaves": self.leaves[right + 1] - self.leaves[at],
            "saved_tokens": saved,
            "ends_sha256": [(hashlib.sha256(joined[i].encode()).hexdigest() if i in joined else _NONE) if w else None
                            for i, w in enumerate(whole.tolist())],
            "first_rank": self.offset + at,
            "__ident": [self._ident(o, d) for o, d in zip(opened.tolist(), depth.tolist())],
            "__up": [self._ident(o, d) for o, d in zip(up_open.tolist(), above.tolist())],
            "__part": np.full(len(at), self.number, np.int32), "__n_ends": n_ends.astype(np.int64),
            "__ends": [None if w else joined.get(i) for i, w in enumerate(whole.tolist())]}


_ARROW = pa.schema([
    ("depth", pa.int32()), *((c, pa.int64()) for c in (
        "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    ("ends_sha256", pa.string()), ("first_rank", pa.int64()), ("__ident", pa.binary()), ("__up", pa.binary()),
    ("__part", pa.int32()), ("__n_ends", pa.int64()), ("__ends", pa.string())])


def _part_nodes(group: pa.Table) -> pa.Table:
    part, found = _Part(group), []
    marks = np.append(part.place, len(part.total))
    for low in range(0, len(part.total), CANDIDATES):
        flat = np.arange(low, min(low + CANDIDATES, len(part.total)))
        at = np.searchsorted(marks, flat, "right") - 1
        columns = part.nodes(at, flat - marks[at])
        found.append(pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW))
    return pa.concat_tables(found)


def _joined_ends(batches):
    """Digest of the ends of each node that spans parts: its texts stream by, part after part."""
    now, digest, any_yet = None, hashlib.sha256(), False
    for batch in batches:
        out: list[tuple] = []
        for ident, ends in zip(batch.column("__ident").to_pylist(), batch.column("__ends").to_pylist()):
            if ident != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, any_yet = ident, hashlib.sha256(), False
            digest.update((("," if any_yet else "") + ends).encode())
            any_yet = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.binary()), pa.array([h for _, h in out])],
                                             ["__ident", "__digest"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["__ident", "__digest"])


def in_order(seqs: DataFrame, key: str = "conv_id") -> DataFrame:
    """The sequences in parts of consecutive ones, each row with its __part, what the part shares
    with the rows __before and __after it (turns; -1: nothing there), and its __offset in all rows.

    Sequences are ordered by their digests, then key, and are divided by range once, so equal ones
    are dealt out too. Both tables are written, as the ranges depend on what is divided.
    """
    kept = stored(seqs.select(F.col(key).cast("long").alias("__key"), "__turns"), "sequences")
    size = kept.agg(F.sum(64 + (DIGEST_BYTES + 8) * F.size("__turns"))).first()[0] or 0
    by = [F.col("__turns.digest"), F.col("__key")]
    placed = stored(kept.repartitionByRange(max(1, -(-size // PART_BYTES)), *by).sortWithinPartitions(*by).withColumn(
        "__part", F.spark_partition_id()), "ranges")
    row = F.struct(F.col("__turns.digest").alias("d"), F.col("__key").alias("k"))
    ends = placed.groupBy("__part").agg(F.min(row).alias("a"), F.max(row).alias("z"), F.count("*").alias("n"))
    along = Window.orderBy("__part")  # a row per part
    edges = stored(ends.select(
        "__part", _shared(F.lag("z.d").over(along), F.col("a.d")).alias("__before"),
        _shared(F.col("z.d"), F.lead("a.d").over(along)).alias("__after"),
        (F.sum("n").over(along) - F.col("n")).alias("__offset")), "edges")
    return attach(placed, edges, ["__part"], ScaleSettings(), "inner")


def prefix_trie(seqs: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per node, a node being the conversations that share their first `depth` turns:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and
    first_rank. Its members are the n_convs rows from first_rank on in the order of `in_order`.

    `seqs` are rows of `sequences`; keys are integers. Every prefix of every sequence is a candidate:
    it finds its extents in its part by halving steps over a table of range minima, and the first
    member there reports the node. Counts and sums come from running sums over the extents. Only
    nodes that span parts (prefixes of a part's first or last sequence) are summed up afterwards.
    Copies are ranges like any other, so no node is gathered in one task, but for the digest of its
    ends, which streams over a text per part. An empty table has no nodes, not even a root.
    """
    small_batches(seqs.sparkSession)
    found = stored(in_order(seqs, key).groupBy("__part").applyInArrow(_part_nodes, _FOUND), "nodes")
    plain = [f.split()[0] for f in _NODE.split(", ")]
    spanning = found.filter("__ident is not null")
    said = spanning.filter("__ends is not null").select("__ident", "__part", "__ends")
    digests = said.repartition("__ident").sortWithinPartitions("__ident", "__part").mapInArrow(
        _joined_ends, "__ident binary, __digest string")
    merged = spanning.groupBy("depth", "__ident").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        (F.sum("n_children") + 1 - F.sum("__n_ends")).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.min("first_rank").alias("first_rank"),
        F.first("__up", True).alias("__up"), F.lit(None).cast("long").alias("parent_conv_id"))
    merged = stored(merged.join(digests, "__ident", "left").withColumn(
        "ends_sha256", F.coalesce("__digest", F.lit(_NONE))), "spanning")
    rows = found.filter("__ident is null").select(*plain, "__up").union(merged.select(*plain, "__up"))
    # The nodes above those that hang below a spanning one.
    above = merged.select(F.col("__ident").alias("__up"), F.col("conv_id").alias("__above"))
    hanging, inside = rows.filter("__up is not null"), rows.filter("__up is null")
    hanging = attach(hanging, above, ["__up"], ScaleSettings()).withColumn("parent_conv_id", F.col("__above"))
    return inside.select(*plain).union(hanging.select(*plain))


#: Rows of the branched conversations' trie, for the conversations table.
TRIE_SQL = """
with own as (
  select conv_id c, coalesce(role, '') r, coalesce(text, '') t,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '')) p
  from conversations where conv_id is not null),
sized as (
  select c, max(p) n, cast(xor(list_reduce(
    list_concat([4294967295::bigint], flatten(list_transform(string_split(c::varchar, ''),
      lambda x: [ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x)
                   else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 9 as bigint) h
  from own group by c),
turns as (
  select s.c, o.p d, o.r, o.t from sized s join own o on o.c = s.c - s.c % 5 and o.p <= s.h
  union all
  select s.c, least(s.h, coalesce(b.n, 0)) + o.p - s.h, o.r, o.t
  from sized s join own o on o.c = s.c and o.p > s.h left join sized b on b.c = s.c - s.c % 5),
prefixes as (
  select c, 0 d, '' path, 0 bytes from sized
  union all
  select c, d, string_agg(md5(length(r) || ':' || r || t), '') over (partition by c order by d) path,
         strlen(t) bytes from turns),
lengths as (select c, max(d) n from prefixes group by c),
nodes as (
  select path, d, min(p.c) conv, count(*) n, any_value(bytes) bytes,
         coalesce(string_agg(case when d = l.n then p.c::varchar end, ',' order by p.c), '') ends
  from prefixes p join lengths l using (c) group by path, d),
kids as (select left(path, 32 * (d - 1)) path, d - 1 d, count(*) n from nodes where d > 0 group by all),
joined as (select n.*, coalesce(k.n, 0) kids from nodes n left join kids k using (path, d)),
below as (
  select left(path, 32 * a) path, a d, sum((kids = 0)::int) leaves, sum((n - 1) * bytes) saved
  from (select *, unnest(range(d + 1)) a from joined) group by all)
select j.conv as conv_id, cast(j.d as int) as depth, p.conv as parent_conv_id, j.n as n_convs,
       j.kids as n_children, cast(b.leaves as bigint) as n_leaves, cast(b.saved as bigint) as saved_tokens,
       sha256(j.ends) as ends_sha256
from joined j join below b using (path, d)
left join nodes p on j.d > 0 and p.d = j.d - 1 and p.path = left(j.path, 32 * (j.d - 1))
"""
