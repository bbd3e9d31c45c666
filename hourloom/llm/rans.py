"""Static range asymmetric numeral system over token ids, in independent interleaved blocks.

A block is a grid of rows and LANES lanes; each lane is a coder of its own, and all lanes of a block
share one stream of 32-bit words. State: 2^31 <= x < 2^63, probabilities in 2^20ths. Coding runs from
the last row up, so that decoding reads rows and words forwards. At every CHECK_ROWS-th row the block
has a checkpoint, the states of all lanes and the place in the words, from which decoding can start.
All blocks and checkpoints of a call are worked on together, one row at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, ROWS, CHECK_ROWS = 64, 512, 256
BLOCK = LANES * ROWS
PROB_BITS = 20
LOW = np.uint64(1 << 31)
_MAGIC = b"RNS1"
_HEAD = struct.Struct("<4sIIII")  # magic, ids, words, checkpoints, crc32 of the ids as 32-bit integers


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Shares of 2^20 in proportion to the counts, one at least for every id that occurs."""
    scale = 1 << PROB_BITS
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    if len(seen) > scale:
        raise ValueError("more ids than shares")
    share = counts[seen].astype(float) * ((scale - len(seen)) / counts[seen].sum())
    out[seen] = 1 + share.astype(np.int64)
    order = seen[np.argsort(-(share - np.floor(share)), kind="stable")]
    out[order[: scale - int(out.sum())]] += 1
    out[seen[np.argmax(counts[seen])]] += scale - int(out.sum())
    return out


class Coder:
    def __init__(self, shares: np.ndarray):
        self.shares = shares.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(shares)[:-1]]).astype(np.uint64)
        self.ids = np.repeat(np.arange(len(shares), dtype=np.uint32), shares)

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """Blocks of BLOCK ids; the last may be shorter."""
        if len(ids) and not self.shares[ids].all():
            raise ValueError("an id without a share can't be encoded")
        full = len(ids) // BLOCK * BLOCK
        out = []
        for at in range(0, full, 64 * BLOCK):
            out += self._encode(ids[at:min(at + 64 * BLOCK, full)], ROWS, BLOCK)
        if full < len(ids):
            rest = ids[full:]
            rows = -(-len(rest) // LANES)
            out += self._encode(np.pad(rest, (0, rows * LANES - len(rest)), "edge"), rows, len(rest))
        return out

    def _encode(self, ids: np.ndarray, rows: int, n: int) -> list[bytes]:
        grid = ids.reshape(-1, rows, LANES)
        blocks = len(grid)
        x = np.full((blocks, LANES), LOW, np.uint64)
        words = np.zeros((blocks, rows, LANES), np.uint32)
        sent = np.zeros((blocks, rows, LANES), bool)
        marks: list[np.ndarray] = []
        for r in range(rows - 1, -1, -1):
            share, start = self.shares[grid[:, r]], self.starts[grid[:, r]]
            over = x >= share << np.uint64(63 - PROB_BITS)
            words[:, r] = x  # the low half
            sent[:, r] = over
            x = np.where(over, x >> np.uint64(32), x)
            q = x // share
            x = (q << np.uint64(PROB_BITS)) + (x - q * share) + start
            if r % CHECK_ROWS == 0:
                marks.append(x)
        states = np.stack(marks[::-1], axis=1)
        placed = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(sent.sum(axis=2), axis=1)], axis=1)
        out = []
        for b in range(blocks):
            own = words[b][sent[b]].astype("<u4")
            crc = zlib.crc32(grid[b].reshape(-1)[:n].astype("<u4").tobytes())
            out.append(_HEAD.pack(_MAGIC, n, len(own), states.shape[1], crc)
                       + placed[b, 0:rows:CHECK_ROWS].astype("<u4").tobytes()
                       + states[b].astype("<u8").tobytes() + own.tobytes())
        return out

    def decode(self, blocks: list[bytes]) -> np.ndarray:
        """The ids of the blocks, one after another. A wrong checksum is an error."""
        if not blocks:
            return np.zeros(0, np.uint32)
        heads = [_HEAD.unpack_from(b) for b in blocks]
        streams, states, places, lengths, before = [], [], [], [], 0
        for data, (magic, n, count, marks, _) in zip(blocks, heads):
            if magic != _MAGIC:
                raise ValueError("not a block of coded ids")
            at = _HEAD.size
            places.append(np.frombuffer(data, "<u4", marks, at).astype(np.int64) + before)
            at += 4 * marks
            states.append(np.frombuffer(data, "<u8", marks * LANES, at).reshape(marks, LANES))
            streams.append(np.frombuffer(data, "<u4", count, at + 8 * marks * LANES))
            rows = -(-n // LANES)
            lengths += [min(CHECK_ROWS, rows - k * CHECK_ROWS) for k in range(marks)]
            before += count
        stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
        x, place, rows = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.array(lengths)
        order = np.argsort(-rows, kind="stable")  # units that end early come last
        x, place, rows = x[order], place[order], rows[order]
        out = np.zeros((len(rows), CHECK_ROWS, LANES), np.uint32)
        low = np.uint64((1 << PROB_BITS) - 1)
        for r in range(int(rows[0])):
            live = int(np.searchsorted(-rows, -r, side="left"))
            if live < len(x):
                x, place = x[:live], place[:live]
            slot = x & low
            ids = self.ids[slot]
            out[:live, r] = ids
            x = self.shares[ids] * (x >> np.uint64(PROB_BITS)) + slot - self.starts[ids]
            need = x < LOW
            upto = np.cumsum(need, axis=1)
            x = np.where(need, (x << np.uint64(32)) | stream[np.minimum(place[:, None] + upto - 1, len(stream) - 1)], x)
            place = place + upto[:, -1]
        back = np.empty_like(out)
        back[order] = out
        ids, unit, parts = back, 0, []
        for _, n, _, marks, crc in heads:
            own = ids[unit:unit + marks].reshape(-1)[:n]
            if zlib.crc32(own.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum is wrong")
            parts.append(own)
            unit += marks
        return np.concatenate(parts)
