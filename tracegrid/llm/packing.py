"""Vector bin packing of token sequences: simultaneous limits on tokens, segments and loss-bearing tokens.

Each task tokenises its rows and packs them by itself, so nothing is shuffled. Whole sequences are cut off long
documents first. The rests wait in a pool; a bin takes, time and again, the waiting rest whose demand vector has
the largest dot product with what the bin has left (both as shares of the limits), among those that fit. Once none
fits, a rest is cut to fill the gap. A task's last bin is cut into sequences with power-of-two lengths, which need
no padding. A bin that meets a limit on segments or loss before it is full is the only one with padding.

Null and empty texts are documents of the end id alone. Copies and repeated rows are packed each; a null doc_id stays
null. Of rests with equal dot products the one that came first is placed. An empty table gives no rows. Other columns,
whatever their names, are ignored. A very long text is cut into as many sequences as it takes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import ship
from tracegrid.llm.tokens import encoder, vocabulary


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; each limit is at least 1, or no sequence could hold anything."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError(f"limits below 1 hold nothing: {self}")


#: Rests that wait at once in a task; at most this many times 1 sequence of ids is held.
POOL = 512


@dataclass
class Item:
    """A run of ids of one document, with how many of its ids bear loss (a suffix of them)."""

    doc: object
    start: int
    ids: np.ndarray
    loss: int
    total: int

    def cut(self, n: int) -> tuple[Item, Item]:
        head_loss = max(0, self.loss - (len(self.ids) - n))
        return (Item(self.doc, self.start, self.ids[:n], head_loss, self.total), Item(self.doc, self.start + n, self.ids[n:], self.loss - head_loss, self.total))


class Packer:
    """Feed items with add(); emit(bin) is called for each full sequence, a list of items."""

    def __init__(self, limits: Limits, emit: Callable[[list[Item]], None]):
        self.limits, self.emit = limits, emit
        self.pool: list[Item] = []

    def add(self, item: Item) -> None:
        whole = self.limits.tokens
        while len(item.ids) >= whole and min(item.loss, whole) <= self.limits.loss:
            head, item = item.cut(whole)
            self.emit([head])
        if len(item.ids):
            self.pool.append(item)
        if len(self.pool) >= POOL:
            self.pack(POOL // 4)

    def pack(self, leave: int) -> None:
        """Fill bins until at most `leave` items wait."""
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.float64)
        need = np.array([[len(x.ids), 1, x.loss] for x in self.pool], np.float64).reshape(-1, 3)
        items, waiting = list(self.pool), np.ones(len(self.pool), bool)
        share = need / cap
        n = len(items)
        while n > leave:
            room, content = cap.copy(), []
            while n:
                fits = waiting & (need <= room).all(axis=1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, share @ (room / cap), -1.0)))
                    content.append(items[k])
                    room -= need[k]
                    waiting[k] = False
                    n -= 1
                elif room[0] > 0 and room[1] > 0 and room[2] > 0:
                    k = int(np.argmax(np.where(waiting, need[:, 0], -1.0)))  # the longest one loses a piece
                    take = min(int(room[0]), len(items[k].ids) - 1)
                    spare = len(items[k].ids) - items[k].loss
                    take = min(take, spare + int(room[2])) if take > spare else take
                    head, items[k] = items[k].cut(take)
                    need[k] = len(items[k].ids), 1, items[k].loss
                    share[k] = need[k] / cap
                    content.append(head)
                    room -= (len(head.ids), 1, head.loss)
                else:
                    break
                if room[0] <= 0:
                    break
            if n <= leave == 0 and room[0] > 0:
                self._powers(content)
            else:
                self.emit(content)
        self.pool = [x for x, w in zip(items, waiting) if w]

    def _powers(self, content: list[Item]) -> None:
        """The last bin as sequences of power-of-two lengths, the longest first."""
        left = sum(len(x.ids) for x in content)
        while left:
            size = 1 << (left.bit_length() - 1)
            out, want = [], size
            while want:
                head, rest = content[0].cut(min(want, len(content[0].ids)))
                out.append(head)
                want -= len(head.ids)
                content = [rest, *content[1:]] if len(rest.ids) else content[1:]
            self.emit(out)
            left -= size

    def finish(self) -> None:
        self.pack(0)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _pieces(vocab: str, cut: str, end_id: int, limits: Limits, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40  # sequences of a task are numbered within its own range

        def emit(content: list[Item]) -> None:
            nonlocal number
            at = 0
            for x in content:
                ids = x.ids.astype("<u4").tobytes()
                rows.append((x.doc, x.start, len(x.ids), zlib.crc32(ids), x.total, number, at, x.loss, *([ids] if keep_ids else [])))
                at += len(x.ids)
            number += 1

        def taken() -> pa.RecordBatch:
            kinds = [pa.int64()] * len(_NAMES) + [pa.binary()] * keep_ids
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES + ["ids"] * keep_ids)
            rows.clear()
            return out

        encode, packer = encoder(vocabulary(vocab), cut), Packer(limits, emit)
        for b in batches:
            docs, texts, prompts = (c.to_pylist() for c in b.columns)
            for doc, text, prompt in zip(docs, texts, prompts):
                before, body = encode.encode([prompt, text])
                ids = np.append(np.concatenate([before, body]) if len(before) else body, np.array([end_id], encode.dtype))
                packer.add(Item(doc, 0, ids, len(ids) - len(before), len(ids)))
                if len(rows) >= 20_000:
                    yield taken()
        packer.finish()
        if rows:
            yield taken()

    return run


def pack(
    docs: DataFrame,
    vocab: str = "byte_bpe_50k.json",
    cut: str = "space",
    end_id: int = 0,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece: its place in its document and in its sequence; with keep_ids also its ids (4 bytes each).

    The ids of `prompt_col`, if given, come first and bear no loss; those of the text and the end id do. `vocab` is a
    public vocabulary file's name, `cut` the way its texts may be cut (see tokens.CUTS).
    """
    ship(docs.sparkSession)
    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), prompt.alias("prompt"))
    return rows.mapInArrow(_pieces(vocab, cut, end_id, limits, keep_ids), PIECES + (", ids binary" if keep_ids else ""))
